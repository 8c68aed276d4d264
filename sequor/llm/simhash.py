"""SimHash near-dedup by multi-index hashing over fingerprint segments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequor.llm.common import WORDS, blocked, connected_components, cut, fresh, prepare, unite, whole_groups

#: Rows of one bucket that one task compares; larger buckets are split into blocks.
BLOCK = 20_000
#: Candidate pairs looked at together inside a task.
PAIRS = 1 << 21
#: Shingles of a part of a group whose pairs are verified; each text counts as ROW more.
SHINGLES, ROW = 1 << 20, 1 << 10
#: Smallest shingle hashes that settle clear cases when a similarity is verified, and how many deviations make one clear.
SKETCH, CLEAR = 1024, 6
FIND = re.compile(WORDS).findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def splitmix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 hash bits of h; for k = 0 h itself."""
    if not k:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle: `shingle` consecutive words, A-Z lower-cased; a shorter text is one shingle."""
    w = FIND((text or "").translate(LOWER))
    if not w:
        return np.zeros(0, np.uint64)
    parts = map(" ".join, zip(*(w[k:] for k in range(shingle)), strict=False)) if len(w) >= shingle else [" ".join(w)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), parts), np.uint64)


def fingerprint(h: np.ndarray, words64: int) -> list[int]:
    """64 * words64 bits as signed 64-bit words: each bit is set if it is in over half the shingle hashes h.

    Repeats included; a text without words, or a null one, has fingerprint zero.
    """
    if not len(h):
        return [0] * words64
    out = []
    for k in range(words64):
        b = splitmix(h, k).astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(h) < 200:
            ones = np.unpackbits(b, axis=1).sum(0, dtype=np.int64)
        else:
            ones = np.concatenate([np.bincount(b[:, x], minlength=256) @ BITS for x in range(8)])
        out.append(int(np.packbits(2 * ones > len(h)).view(">i8")[0]))
    return out


def with_fingerprints(docs: DataFrame, text_col: str, keep: list[str], shingle: int, words64: int, node: bool = False) -> DataFrame:
    """The columns `keep` and f0, f1, ...: the fingerprint's words; with node, _node: the hash of the set of shingles."""
    names = [f"f{k}" for k in range(words64)]
    more = ["_node"] if node else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, shingle) for t in b.column(0).to_pylist()]
            fps = np.array([fingerprint(h, words64) for h in hashes], np.int64).reshape(-1, words64)
            sets = [pa.array(np.array([xxhash.xxh64_intdigest(np.unique(h).tobytes()) for h in hashes], np.uint64).view(np.int64))] if node else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(fps[:, k]) for k in range(words64)), *sets], names=[*keep, *names, *more])

    kinds = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *(T.StructField(n, T.LongType()) for n in [*names, *more])])
    return docs.select(F.col(text_col).alias("_text"), *keep).mapInArrow(run, kinds)


def closest_forest(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which edges (i, j) make the minimum spanning forest by (far, place in the list): Boruvka's rounds."""
    order = np.argsort(far, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    label, open_, chosen = np.arange(n), np.arange(len(i)), [np.zeros(0, np.int64)]
    while True:
        a, b = label[i[open_]], label[j[open_]]
        apart = a != b
        open_, a, b = open_[apart], a[apart], b[apart]
        if not len(open_):
            return np.concatenate(chosen)
        best = np.full(n, len(order))
        np.minimum.at(best, a, rank[open_])
        np.minimum.at(best, b, rank[open_])
        picked = order[np.unique(best[best < len(order)])]
        chosen.append(picked)
        unite(label, i[picked], j[picked])


def hamming_links(prints: DataFrame, rep: str, names: list[str], half: int, distance: int, closest: bool = False) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints that differ in <= distance bits.

    With closest, edges are links themselves: those of the minimum spanning forest by distance.

    The fingerprint is cut into segments of 2 * half bits and each segment is probed with its ball of
    radius one: a pair within 2 * (number of segments) - 1 bits always meets, and one further
    apart with the chance that some segment differs in one bit or none. Two segments within one bit agree in
    one half; so a fingerprint goes to one bucket per half (segment, half, its bits), and the
    bucket's task enumerates the ball of the other half, fetches matches by binary search
    and verifies the complete distance. Only a spanning forest of a bucket's links leaves the task.
    """
    per = 64 // half
    mask = (1 << half) - 1
    cells = [F.struct(F.lit(k * per + b).alias("cell"), F.shiftrightunsigned(F.col(n), half * b).bitwiseAND(F.lit(mask)).alias("bits")) for k, n in enumerate(names) for b in range(per)]
    d = prints.select(F.col(rep).alias("id"), *names, F.explode(F.array(*cells)).alias("c"))
    d = d.select("id", *names, (F.col("c.cell").cast("long") * (1 << half) + F.col("c.bits")).alias("bucket"))
    d = blocked(d, ["bucket"], F.col("id"), BLOCK)
    keys = ["bucket", "_i", "_j"]
    d = d.select("bucket", F.col("_i").cast("int").alias("_i"), F.col("_j").cast("int").alias("_j"), "id", *names).repartition(*keys).sortWithinPartitions(*keys)
    balls = [0, *(1 << k for k in range(half))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            bucket, bi, bj, ids = (t.column(c).to_numpy() for c in ("bucket", "_i", "_j", "id"))
            f = np.stack([t.column(n).to_numpy() for n in names], 1).view(np.uint64)
            job = np.concatenate([[0], np.cumsum((bucket[1:] != bucket[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]))])
            cell = bucket >> half
            partner = cell ^ 1
            other = (f[np.arange(len(f)), partner // per] >> (half * (partner % per)).astype(np.uint64)) & np.uint64(mask)
            key = (job.astype(np.uint64) << np.uint64(half)) | other
            order = np.argsort(key, kind="stable")
            key, f, ids = key[order], f[order], ids[order]
            label = np.arange(len(key))
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for ball in balls:
                goal = key ^ np.uint64(ball)
                lo = np.searchsorted(key, goal, "left")
                hi = np.searchsorted(key, goal, "right")
                if ball:
                    hi = np.where(goal > key, hi, lo)
                else:
                    lo = np.arange(len(key)) + 1
                n = hi - lo
                ends = np.cumsum(n)
                start = 0
                while start < len(n):
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
                    m = n[start:stop]
                    if m.sum():
                        i = np.repeat(np.arange(start, stop), m)
                        j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[start:stop], m)
                        far = np.bitwise_count(f[i] ^ f[j]).sum(1, dtype=np.int64)
                        near = far <= distance
                        if near.any():
                            if closest:
                                held = tuple(np.concatenate([x, y[near]]) for x, y in zip(held, (i, j, far), strict=True))
                                stay = closest_forest(len(key), *held)
                                held = tuple(x[stay] for x in held)
                            else:
                                unite(label, i[near], j[near])
                    start = stop
            child = np.flatnonzero(label != np.arange(len(label)))
            a, b = (ids[held[0]], ids[held[1]]) if closest else (ids[child], ids[label[child]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return d.mapInArrow(run, "a long, b long")


def components(rows: DataFrame, id_col: str, names: list[str], half: int, distance: int) -> DataFrame:
    """rows (materialised) with component_id: the smallest id reachable by links, itself included.

    Equal fingerprints are one node. A null id never names a component; rows with a null id get null
    if no other row shares their fingerprint or component.
    """
    prints = cut(rows.groupBy(*names).agg(F.min(id_col).alias("_rep")))
    edges = hamming_links(prints.where("_rep is not null"), "_rep", names, half, distance)
    found = connected_components(edges, "a", "b")
    named = prints.join(found.withColumnRenamed("node", "_rep"), "_rep", "left").select(*names, F.coalesce("root", "_rep").alias("component_id"))
    return rows.join(named, names)


def shared(u: np.ndarray, v: np.ndarray) -> tuple[int, int]:
    """How many hashes two sorted sets have in common and together."""
    both = np.sort(np.concatenate([u, v]))
    twice = int((both[1:] == both[:-1]).sum())
    return twice, len(both) - twice


def settled(u: np.ndarray, v: np.ndarray, least: float) -> bool | None:
    """Whether sets with the smallest SKETCH hashes u and v have a Jaccard similarity of `least`; None if that is unclear."""
    if len(u) < SKETCH and len(v) < SKETCH:
        common, whole = shared(u, v)
        return common >= least * whole
    both = np.sort(np.concatenate([u, v]))
    twice = both[1:][both[1:] == both[:-1]]
    whole = np.unique(both)[:SKETCH]
    guess = (twice <= whole[-1]).sum() / len(whole)
    return None if abs(guess - least) <= CLEAR * (least * (1 - least) / SKETCH) ** 0.5 else bool(guess >= least)


def similar(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The edges (a, b) between nodes of sets (node, s) whose sets of shingles have a Jaccard similarity of `least`.

    The smallest hashes settle clear cases; the others are decided by the whole sets.
    """

    def compare(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if whole:
                    common, total = shared(u, v)
                    ok.append(common >= least * total)
                else:
                    ok.append(settled(u, v, least))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    def compared(edges: DataFrame, s: DataFrame, whole: bool) -> DataFrame:
        d = edges.join(s.toDF("a", "_a"), "a").join(s.toDF("b", "_b"), "b").select("a", "b", "_a", "_b")
        return d.mapInArrow(partial(compare, whole=whole), "a long, b long, ok boolean")

    low = sets.select("node", F.expr(f"substring(s, 1, {8 * SKETCH})"))
    first = cut(compared(edges, low, False))
    exact = compared(first.where("ok is null").select("a", "b"), sets.select("node", "s"), True)
    return first.where("ok").unionAll(exact.where("ok")).select("a", "b")


def join_open(label: np.ndarray, own: np.ndarray, f: np.ndarray, sets: list[np.ndarray], distance: int, least: float) -> np.ndarray:
    """The tree of each label once no two similar texts of different trees are left; own: pairs within a part are another job's, unless there is one part.

    Pairs within `distance` bits are looked at from the closest on, as many at a time as there are texts;
    a pair is left out only if its texts are in one tree already.
    """
    n, tree, sizes = len(f), np.arange(label.max() + 1), np.array([len(x) for x in sets])
    whole, step = (own == own[0]).all(), max(1, (PAIRS >> 3) // len(f))
    held = []
    for at in range(0, n, step):
        i = np.arange(at, min(n, at + step))[:, None]
        j = np.arange(n)[None]
        far = np.bitwise_count(f[i] ^ f[j]).sum(2, dtype=np.int16)
        ok = (i < j) & (far <= distance) & (label[i] != label[j]) & (np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]))
        if not whole:
            ok &= own[i] != own[j]
        x, y = np.nonzero(ok)
        held.append(np.stack([x + at, y, far[x, y]]).astype(np.int32))
    i, j, far = np.concatenate(held, 1)
    order = np.argsort(far, kind="stable")
    for at in range(0, len(order), max(n, 64)):
        e = order[at : at + max(n, 64)]
        e = e[tree[label[i[e]]] != tree[label[j[e]]]]
        good = []
        for k in e:
            common, total = shared(sets[i[k]], sets[j[k]])
            if common >= least * total:
                good.append(k)
        if good:
            unite(tree, label[i[good]], label[j[good]])
    return tree


def open_links(nodes: DataFrame, prints: DataFrame, sets: DataFrame, names: list[str], distance: int, least: float) -> DataFrame:
    """Edges that join the labels of nodes (node, group, label) wherever two texts of a group are similar.

    Only groups with several labels are looked at, and in them every pair of different labels within
    `distance` bits. Large groups are split by their shingles into blocks of which each two meet.
    """
    several = nodes.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("group")
    rest = cut(nodes.join(several, "group", "left_semi").join(sets.select("node", F.length("s").alias("_bytes")), "node"))
    d = blocked(rest, ["group"], F.col("node"), SHINGLES, F.expr(f"_bytes div 8 + {ROW}"))
    keys = ["group", "_i", "_j"]
    d = d.join(prints, "node").join(sets, "node").select("group", F.col("_i").cast("int").alias("_i"), F.col("_j").cast("int").alias("_j"), F.col("_own").cast("int").alias("_own"), "node", "label", *names, "s")
    d = d.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            group, bi, bj, own, node, label = (t.column(c).to_numpy() for c in (*keys, "_own", "node", "label"))
            f = np.stack([t.column(n).to_numpy() for n in names], 1).view(np.uint64)
            ends = np.flatnonzero((group[1:] != group[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            for lo, hi in zip([0, *ends], [*ends, len(group)], strict=True):
                _, first, local = np.unique(label[lo:hi], return_index=True, return_inverse=True)
                if len(first) == 1:
                    continue
                s = [np.frombuffer(x, np.uint64) for x in t.column("s").slice(lo, hi - lo).to_pylist()]
                tree = join_open(local, own[lo:hi], f[lo:hi], s, distance, least)
                child = np.flatnonzero(tree != np.arange(len(tree)))
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][first[child]]), pa.array(node[lo:hi][first[tree[child]]])], names=["a", "b"])

    return d.mapInArrow(run, "a long, b long")


def rooted(nodes: DataFrame, edges: DataFrame, out: str) -> DataFrame:
    """nodes with the column out: the smallest node of each one's component."""
    found = connected_components(edges, "a", "b").withColumnRenamed("root", "_root")
    return nodes.join(found, "node", "left").withColumn(out, F.coalesce("_root", "node")).drop("_root")


def near_copies(rows: DataFrame, texts: DataFrame, key: list[str], names: list[str], shingle: int, half: int, distance: int, least: float) -> DataFrame:
    """rows (materialised: key, names, _node) with root: equal for rows linked by texts of a similarity of `least`.

    Equal sets of shingles are one node. The edges of each bucket's closest forest are verified first;
    then, in the groups of candidates that these leave apart, all other pairs.
    """
    prints = cut(rows.select(F.col("_node").alias("node"), *names).distinct())
    edges = hamming_links(prints, "node", names, half, distance, True)
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = cut(edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct())
    one = rows.join(ids, F.col("_node") == F.col("node"), "left_semi").groupBy(F.col("_node").alias("node")).agg(F.min(F.struct(*key)).alias("k"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary())], names=["node", "s"])

    s = texts.join(one.select("node", "k.*"), key).select("node", "_t").mapInArrow(hashes, "node long, s binary")
    sets = cut(s.dropDuplicates(["node"]))
    good = cut(similar(edges, sets, least))
    nodes = cut(rooted(rooted(ids, edges, "group"), good, "label"))
    more = open_links(nodes, prints, sets, names, distance, least)
    found = rooted(ids, good.unionAll(more), "root").withColumnRenamed("node", "_node")
    return rows.join(found, "_node", "left").withColumn("root", F.coalesce("root", "_node"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words64: int = 1, half: int = 16, distance: int = 2) -> DataFrame:
    """doc_id, f0.. and component_id of every row; by default 64 bits, 3-word shingles, 2 bits apart."""
    prepare(docs.sparkSession)
    names = [f"f{k}" for k in range(words64)]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    rows = cut(with_fingerprints(d, "_t", ["doc_id"], shingle, words64))
    return components(rows, "doc_id", names, half, distance)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies in the pipeline: five-word shingles, 256 bits, 16-bit segments. A similarity (Jaccard) of
#: 0.8 is a cosine of 0.89, an angle of 0.15 pi: 39 of 256 bits on average, with a deviation of 6. Links at
#: two deviations more are candidates.
NEAR = {"shingle": 5, "words64": 4, "half": 8, "distance": 51, "least": 0.8}


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies the row with the smallest id (of these, the least text hash), with all columns of whatever names.

    Rows that repeat an id and text count once; rows of one id with texts of different groups all stay. Rows with a null id can't be named and stay.
    """
    prepare(docs.sparkSession)
    near = dict(NEAR)
    shingle, words64 = near.pop("shingle"), near.pop("words64")
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t"))
    key, names = ["doc_id", "_h"], [f"f{k}" for k in range(words64)]
    rows = cut(with_fingerprints(d, "_t", key, shingle, words64, True))
    found = near_copies(rows, d, key, names, shingle, **near)
    hashed, number = fresh(docs, "_sq_hash"), fresh(docs, "_sq_row")
    stay = found.groupBy("root").agg(F.min(F.struct(*key)).alias("k")).select(F.col("k.doc_id").alias(id_col), F.col("k._h").alias(hashed))
    first = Window.partitionBy(id_col, hashed).orderBy(F.lit(0))
    kept = docs.withColumn(hashed, F.xxhash64(text_col)).join(stay, [id_col, hashed], "left_semi").withColumn(number, F.row_number().over(first)).where(F.col(number) == 1)
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
