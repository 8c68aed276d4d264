"""Removal of repeated passages: winnowed anchors, extension to both sides, maximal repeats.

Two operators share the search. `remove_later_words` (substring dedup) joins documents on anchors of a few words, extends
each match to both sides and removes words that repeat an earlier window. `remove_repeated_bytes` (suffix-array dedup) keeps a
logarithmic family of suffix arrays of the anchored positions and removes bytes of strings found twice.

A window (20 words, 200 bytes) is assigned to its anchor: the first gram in it with the smallest hash, which
depends on the window's content alone, so equal windows have equal anchors. Consecutive windows with
one anchor are a run; its context is all that they cover. Steps, each a distributed job:

1. Runs (anchor, context hash, document, start, length) of all documents; those whose anchor is found
   only once can't repeat and are left out.
2. Runs with equal contexts repeat whole: a partial aggregation makes them one class with a first member.
3. Where an anchor stands in different contexts, the first members' contexts are fetched. Keys with more than
   CONTEXTS of them are lengthened: from the smallest gram of a window to its 4, 16, ... smallest, up to all of them,
   with equal contexts made one class again, so that no task gets a large group.
4. Contexts of a key are laid over each other at the anchor and extended to both sides, unit by unit: each with each earlier
   one (words), or along the order of their suffixes, batch by batch, against the levels of the index (bytes).
5. The stretches of a document are united to maximal repeats and removed.

Anchors and whole contexts are compared by 64-bit hashes used together; extension compares bytes, and words by a hash each. No
step gathers the rows of an anchor in one task: keys with a large share of the rows are joined by broadcast, of which there
can only be few.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequor.llm.common import WORDS, Stash, fresh, join_counted, prepare, release, whole_groups

FIND = re.compile(WORDS).findall
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Units (words or bytes) of a text worked on at once; longer texts go in overlapping parts.
PART = 1 << 20
CACHE_WORDS = 300_000
#: Different contexts of a key that one task lays over each other; keys of more are lengthened.
CONTEXTS = 256
#: Batches that the documents come in to the index of suffix arrays.
BATCHES = 5
#: Bytes of contexts in a bucket of the index, on average, and pairs that are compared at once.
BUCKET_BYTES, PAIRS = 4 << 20, 1 << 15
#: A null id counts as this one.
NO_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def pair(a: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice the width from those of `width` units."""
    return mix(a[:-width] * ODD + (a[width:] ^ np.uint64(0x2545F4914F6CDD1D)))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


class Powers:
    """Powers of ODD and its inverse modulo 2 ** 64, as long as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 14)
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, ODD)])
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, INVERSE)])
        return cls.up, cls.down


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, seed=7)
        return h


class Words:
    """Texts as words; anchors of 4 words in windows of 20."""

    window, gram, unit, dtype = 20, 4, 1, np.uint64
    hashes = WordHashes()

    @classmethod
    def units(cls, text: str) -> np.ndarray:
        words = FIND(text)
        return np.fromiter(map(cls.hashes.__getitem__, words), np.uint64, len(words))

    @classmethod
    def base(cls, u: np.ndarray) -> np.ndarray:
        return u

    @classmethod
    def grams(cls, base: np.ndarray) -> np.ndarray:
        return pair(pair(base, 1), 2)


class Bytes:
    """Texts as UTF-8 bytes; anchors of 32 bytes in windows of 200."""

    window, gram, unit, dtype = 200, 32, 8, np.uint8

    @classmethod
    def units(cls, text: str) -> np.ndarray:
        return np.frombuffer(text.encode(), np.uint8)

    @classmethod
    def base(cls, u: np.ndarray) -> np.ndarray:
        """The hash of the 8 bytes from each place on."""
        out = np.empty(len(u) - 7, np.uint64)
        for k in range(8):
            out[k::8] = u[k : k + (len(u) - k) // 8 * 8].view("<u8")
        return mix(out * ODD)

    @classmethod
    def grams(cls, base: np.ndarray) -> np.ndarray:
        return pair(pair(base, 8), 16)


Kind = type[Words] | type[Bytes]


def runs_of(kind: Kind, u: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, context, start, length) of the runs of one text, part by part."""
    w = kind.window
    for at in range(0, len(u) - w + 1, PART):
        base = kind.base(u[at : at + PART + w - 1])
        grams = kind.grams(base)
        low = sliding_min(grams, w - kind.gram + 1)
        # a run ends where its anchor leaves the window, even if an equal gram follows
        s = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1])])
        n = np.diff(np.r_[s, len(low)])
        up, down = Powers.of(len(base) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(base * up[: len(base)])])
        context = (sums[s + n + w - kind.unit] - sums[s]) * down[s]
        yield low[s], mix(context + n.astype(np.uint64)), s + at, n


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64, copy=False).view(np.int64))


def lists(column: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """The structs of each list as arrays by field; a null list is empty."""
    flat = column.flatten()
    fields = {f.name: a.to_numpy(zero_copy_only=False) for f, a in zip(flat.type, flat.flatten(), strict=True)}
    ends = np.cumsum(np.r_[0, pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)]).tolist()
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        yield {k: v[lo:hi] for k, v in fields.items()}


def find_runs(docs: DataFrame, kind: Kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for at, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for a, c, s, n in runs_of(kind, kind.units(text)):
                    for x, y in zip(cols, (a, c, np.full(len(a), at, np.int64), np.full(len(a), doc, np.int64), s, n), strict=True):
                        x.append(y)
            if cols[0]:
                a, c, i, d, s, n = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays([signed(a), signed(c), pa.array(i), pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "context", "id", "doc", "start", "n"])

    return docs.select("id", "doc", "text").mapInArrow(run, "anchor long, context long, id long, doc long, start int, n int")


CONTEXT = "key long, id long, doc long, start int, n int, at int, content binary"


def open_contexts(listed: DataFrame, kind: Kind) -> DataFrame:
    """Rows of CONTEXT: what the listed runs cover, and where in it the anchor stands."""
    width = kind.window - kind.gram + 1
    names = ["key", "id", "doc", "start", "n", "at", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for of, doc, text, found in zip(*(c.to_pylist() for c in b.columns[:3]), lists(b.column(3)), strict=True):
                u = kind.units(text)
                whole = kind.grams(kind.base(u)) if len(u) < PART else None
                for k in range(0, len(found["start"]), 4000):
                    anchor, start, n = (found[c][k : k + 4000] for c in ("anchor", "start", "n"))
                    at, content = [], []
                    for a, x, y in zip(anchor.view(np.uint64), start.tolist(), n.tolist(), strict=True):
                        covers = u[x : x + y + kind.window - 1]
                        grams = kind.grams(kind.base(covers))[:width] if whole is None else whole[x : x + width]
                        at.append(int((grams == a).argmax()))
                        content.append(covers.tobytes())
                    ids = (pa.array(np.full(len(at), v, np.int64)) for v in (of, doc))
                    cols = [pa.array(anchor), *ids, pa.array(start), pa.array(n), pa.array(at, pa.int32()), pa.array(content, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return listed.mapInArrow(run, CONTEXT)


def smallest_grams(grams: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of n windows a hash of the k smallest hashes of its grams."""
    per = len(grams) - n + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, per)
    k = min(k, per)
    low = np.sort(view if k == per else np.partition(view, k - 1, axis=1)[:, :k], axis=1)
    return mix(low @ Powers.of(per + 1)[0][1 : k + 1])


def lengthened(contexts: DataFrame, kind: Kind, k: int) -> DataFrame:
    """The runs of the contexts' windows by their k smallest grams, with the hash of what they cover as `context`."""
    w = kind.window
    size = np.dtype(kind.dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            _, of, doc, start, count, at, content = (c.to_pylist() for c in b.columns)
            for i, d, x, n, a, raw in zip(of, doc, start, count, at, content, strict=True):
                u = np.frombuffer(raw, kind.dtype)
                keys = smallest_grams(kind.grams(kind.base(u)), n, k)
                begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), n], strict=True):
                    part = raw[lo * size : (hi + w - 1) * size]
                    out.append((keys[lo], xxhash.xxh64_intdigest(part), i, d, x + lo, hi - lo, a - lo, part))
            if out:
                key, context, *rest, parts = zip(*out, strict=True)
                of_rest = [pa.array(v, t) for v, t in zip(rest, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                cols = [signed(np.array(key, np.uint64)), signed(np.array(context, np.uint64)), *of_rest, pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "context", "id", "doc", "start", "n", "at", "content"])

    return contexts.mapInArrow(run, CONTEXT.replace("key long,", "key long, context long,"))


def small_groups(contexts: Stash, kind: Kind, later: bool) -> tuple[list[DataFrame], list[Stash], list[DataFrame]]:
    """Contexts whose keys have at most CONTEXTS of them (parts to unite), tables these read, and stretches found on the way."""
    parts, tables, found = [], [contexts], []
    k = 4
    while True:
        sizes = Stash(tables[-1].df.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CONTEXTS))
        tables.append(sizes)
        if sizes.df.isEmpty() or k > 4 * kind.window:
            parts.append(tables[-2].df)
            return parts, tables, found
        rows, hot = tables[-2].df, sizes.df
        parts.append(rows.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "key", "left_anti"))
        longer = Stash(lengthened(join_counted(rows, hot, ["key"], "k").drop("k"), kind, k))
        first = F.min(F.struct("id", "doc", "start", "n", "at", "content")).alias("first")
        equal = Stash(longer.df.groupBy("key", "context").agg(F.count(F.lit(1)).alias("k"), first))
        place = F.struct("first.id", "first.doc", "first.start").alias("first")
        whole = join_counted(longer.df.drop("content"), equal.df.where("k > 1").select("key", "context", "k", place), ["key", "context"], "k")
        if later:
            whole = whole.where(F.struct("id", "doc", "start") > F.col("first"))
        found.append(whole.select("doc", "start", "n"))
        tables += [longer, equal, Stash(equal.df.select("key", "first.*"))]
        k *= 4


class Laid:
    """Contexts laid over each other at their anchors: units to the right of its start, and to the left in reverse."""

    def __init__(self, kind: Kind, key: np.ndarray, at: np.ndarray, n: np.ndarray, contents: list[bytes]):
        self.w, self.key, self.at, self.n = kind.window, key, at.astype(np.int64), n.astype(np.int64)
        size = np.dtype(kind.dtype).itemsize
        length = np.array([len(c) // size for c in contents], np.int64)
        flat = np.frombuffer(b"".join(contents), kind.dtype)
        begin = np.cumsum(length) - length + self.at
        self.left_n, self.right_n = self.at, length - self.at
        self.right = self.spread(flat, begin, self.right_n, kind.window, 1)
        self.left = self.spread(flat, begin - 1, self.left_n, kind.window - kind.gram, -1)

    @staticmethod
    def spread(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
        k = np.arange(width)
        if not len(begin):
            return np.zeros((0, width), flat.dtype)
        out = flat[np.clip(begin[:, None] + step * k, 0, len(flat) - 1)]
        out[k >= length[:, None]] = 0
        return out

    def order(self) -> np.ndarray:
        """Keys and the units to the right as strings that compare like them (bytes only)."""
        if not len(self.key):
            return np.zeros(0, f"S{8 + self.w}")
        keys = self.key.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        return np.ascontiguousarray(np.concatenate([keys, self.right], 1)).view(f"S{8 + self.w}").ravel()

    def take(self, rows: np.ndarray) -> Laid:
        out = object.__new__(Laid)
        out.w = self.w
        for c in ("key", "at", "n", "left_n", "right_n", "right", "left"):
            setattr(out, c, getattr(self, c)[rows])
        return out

    def common(self, side: str, i: np.ndarray, other: Laid, j: np.ndarray) -> np.ndarray:
        """How many units to a side of the anchors of self[i] and other[j] are equal, from the anchor on."""
        a, b = getattr(self, side), getattr(other, side)
        least = np.minimum(getattr(self, side + "_n")[i], getattr(other, side + "_n")[j])
        out = np.empty(len(i), np.int64)
        for lo in range(0, len(i), PAIRS):
            differ = a[i[lo : lo + PAIRS]] != b[j[lo : lo + PAIRS]]
            first = differ.argmax(1)
            out[lo : lo + PAIRS] = np.where(differ[np.arange(len(differ)), first], first, a.shape[1])
        return np.minimum(out, least)

    def extend(self, i: np.ndarray, other: Laid, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both ways from the anchors of self[i] and other[j]: units in common to the right, to the left, and whether a window fits."""
        right = self.common("right", i, other, j)
        left = np.zeros(len(i), np.int64)
        some = np.flatnonzero(right + np.minimum(self.left_n[i], other.left_n[j]) >= self.w)
        left[some] = self.common("left", i[some], other, j[some])
        return right, left, left + right >= self.w


class Marks:
    """Which windows of some contexts repeat: stretches are added one by one and united at the end."""

    def __init__(self, laid: Laid):
        self.laid = laid
        self.step = np.zeros((len(laid.n), int(laid.n.max(initial=0)) + 1), np.int32)

    def add(self, i: np.ndarray, right: np.ndarray, left: np.ndarray) -> None:
        """Windows of context i (which may stand there more than once) in the match that goes `left` and `right` from the anchor."""
        lo = np.maximum(0, self.laid.at[i] - left)
        hi = np.minimum(self.laid.n[i] - 1, self.laid.at[i] + right - self.laid.w)
        ok = lo <= hi
        np.add.at(self.step, (i[ok], lo[ok]), 1)
        np.add.at(self.step, (i[ok], hi[ok] + 1), -1)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, first window, windows) of maximal stretches."""
        hit = (np.cumsum(self.step, axis=1) > 0).astype(np.int8)
        edge = np.diff(hit, axis=1, prepend=0)
        row, lo = np.nonzero(edge == 1)
        return row, lo, np.nonzero(edge == -1)[1] - lo


def stretch_rows(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "start", "n"])


def seed_and_extend(contexts: DataFrame) -> DataFrame:
    """(doc, start, n): stretches of windows that an earlier context of the same key holds too. Words only."""
    d = contexts.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key"]):
            key, of, doc, start, n, at = (t.column(c).to_numpy() for c in ("key", "id", "doc", "start", "n", "at"))
            order = np.lexsort((start + at, doc, of, key))
            contents = t.column("content").to_pylist()
            laid = Laid(Words, key[order], at[order], n[order], [contents[k] for k in order])
            doc, start, marks = doc[order], start[order], Marks(laid)
            seed = start + laid.at
            step, i = 1, np.arange(len(key))
            while len(i := i[i >= step]) and len(i := i[laid.key[i] == laid.key[i - step]]):
                other = (doc[i] != doc[i - step]) | (seed[i] != seed[i - step])  # a repeated row doesn't precede itself
                p = i[other]
                right, left, fits = laid.extend(p, laid, p - step)
                marks.add(p[fits], right[fits], left[fits])
                step += 1
            row, lo, count = marks.stretches()
            if len(row):
                yield stretch_rows(doc[row], start[row] + lo, count)

    return d.mapInArrow(run, "doc long, start int, n int")


def scan(a: Laid, a_marks: Marks, b: Laid, b_marks: Marks, place: np.ndarray) -> None:
    """Walk with each suffix of b through the sorted ones of a, from its place there, and mark the matches of both.

    What a suffix has in common with others of its key falls with the distance in the order, so a walk ends where
    the left side can't make up for it. If a is b, only the way up is walked.
    """
    for way in (1,) if a is b else (1, -1):
        i, at = np.arange(len(b.key)), place + 1 if a is b else place if way > 0 else place - 1
        while True:
            ok = (at >= 0) & (at < len(a.key))
            i, at = i[ok], at[ok]
            ok = a.key[at] == b.key[i]
            i, at = i[ok], at[ok]
            if not len(i):
                break
            right, left, fits = b.extend(i, a, at)
            b_marks.add(i[fits], right[fits], left[fits])
            a_marks.add(at[fits], right[fits], left[fits])
            on = right + b.left_n[i] >= b.w
            i, at = i[on], at[on] + way


def merged(a: np.ndarray, a_rows: np.ndarray, b: np.ndarray, b_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of strings, and the rows they stand for, merged."""
    at = np.searchsorted(a, b) + np.arange(len(b))
    rest = np.ones(len(a) + len(b), bool)
    rest[at] = False
    strings, rows = np.empty(len(rest), b.dtype), np.empty(len(rest), np.int64)
    strings[at], strings[rest] = b, a
    rows[at], rows[rest] = b_rows, a_rows
    return strings, rows


class SuffixArrays:
    """A logarithmic family of suffix arrays in the shared folder.

    The suffixes are those that begin at the anchors of the contexts, sorted by key and bytes to the right; a level is
    a table of them in buckets of whole keys, in their order. A new batch gets suffix arrays of its own and is merge-scanned
    against all levels for windows that both hold; then the last levels that aren't over twice as large as
    what comes in are merged with it, sorted list by sorted list. So there are at most about log2 of the batches levels, and a
    suffix is written as often. Each call is one job over the batch and the levels; a bucket's rows meet in a task.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.levels: list[tuple[Stash, int]] = []

    def add(self, batch: DataFrame) -> Stash:
        """Take in rows of CONTEXT; returns the stretches (doc, start, n) of windows found twice in the batch, or in it and a level."""
        size, new = batch.count(), len(self.levels)
        keep = new
        while keep and self.levels[keep - 1][1] <= 2 * size:
            keep -= 1
            size += self.levels[keep][1]
        names = [f.split()[0] for f in CONTEXT.split(", ")]
        rows = batch.select(*names, F.lit(new).alias("level"), F.lit(0).cast("long").alias("place"))
        for k, (table, _) in enumerate(self.levels):
            rows = rows.unionAll(table.df.where("hit = false").select(*names, F.lit(k).alias("level"), "place"))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "level", "place")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in whole_groups(batches, ["bucket"]):
                bucket = whole.column("bucket").to_numpy()
                ends = [*(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
                for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                    yield from take_in(whole.slice(lo, hi - lo), new, keep)

        table = Stash(rows.select("bucket", "level", "place", *names).mapInArrow(run, f"hit boolean, place long, {CONTEXT}"))
        hits = Stash(table.df.where("hit").select("doc", "start", "n"))
        for old, _ in self.levels[keep:]:
            old.drop()
        self.levels[keep:] = [(table, size)]
        return hits

    def drop(self) -> None:
        for table, _ in self.levels:
            table.drop()
        self.levels = []


def take_in(t: pa.Table, new: int, keep: int) -> Iterator[pa.RecordBatch]:
    """One bucket of a batch (level `new`) and the levels, these in their order: the merged level of those from `keep` on, and hits."""
    level, contents = t.column("level").to_numpy(), t.column("content").to_pylist()
    col = {c: t.column(c).to_numpy() for c in ("key", "id", "doc", "start", "n", "at")}

    def out(hit: bool, rows: np.ndarray, place: np.ndarray, start: np.ndarray, n: np.ndarray, content: list[bytes]) -> pa.RecordBatch:
        change = {"start": start.astype(np.int32), "n": n.astype(np.int32)}
        cols = [pa.array(change[c] if c in change else v[rows]) for c, v in col.items()]
        head = [pa.array(np.full(len(rows), hit)), pa.array(place.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*head, *cols, pa.array(content, pa.binary())], names=["hit", "place", *col, "content"])

    rows = [np.flatnonzero(level == k) for k in range(new + 1)]
    laid = [Laid(Bytes, col["key"][r], col["at"][r], col["n"][r], [contents[x] for x in r]) for r in rows]
    order = np.argsort(laid[new].order(), kind="stable")
    rows[new], laid[new] = rows[new][order], laid[new].take(order)
    strings, marks = [x.order() for x in laid], [Marks(x) for x in laid]
    for k in range(new + 1):
        place = np.arange(len(order)) if k == new else np.searchsorted(strings[k], strings[new])
        scan(laid[k], marks[k], laid[new], marks[new], place)
    for m, r in zip(marks, rows, strict=True):
        row, lo, count = m.stretches()
        if len(row):
            yield out(True, r[row], np.zeros(len(row)), col["start"][r[row]] + lo, count, [b""] * len(row))
    s, r = strings[new], rows[new]
    for k in range(new - 1, keep - 1, -1):
        s, r = merged(strings[k], rows[k], s, r)
    for x in range(0, len(r), 20_000):
        some = r[x : x + 20_000]
        yield out(False, some, np.arange(x, x + len(some)), col["start"][some], col["n"][some], [contents[y] for y in some])


def repeated_stretches(docs: DataFrame, kind: Kind, later: bool) -> tuple[DataFrame, list[Stash]]:
    """(doc, found): the stretches of windows, as (first window, how many), that repeat (later: an earlier window).

    docs has id (long), doc (long: stands for the id and text, so that every row has the text of its doc) and
    text; rows are earlier by (id, doc, start). Returns also the tables in the shared folder that the result reads.
    """
    spark = docs.sparkSession
    runs = Stash(find_runs(docs, kind))
    shared = runs.df.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), (F.min("context") != F.max("context")).alias("open")).where("k > 1")
    shared = Stash(shared)
    release(spark)
    found = Stash(join_counted(runs.df, shared.df, ["anchor"], "k").drop("k"))
    runs.drop()
    shared.drop()
    release(spark)
    equal = Stash(found.df.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "doc", "start", "n")).alias("first"), F.max("open").alias("open")))
    several = equal.df.where("k > 1").select("anchor", "context", "k", F.struct("first.id", "first.doc", "first.start").alias("first"))
    whole = join_counted(found.df, several, ["anchor", "context"], "k")
    if later:
        whole = whole.where(F.struct("id", "doc", "start") > F.col("first"))
    whole = Stash(whole.select("doc", "start", "n"))
    found.drop()
    left = equal.df.where("open").select("anchor", "first.doc", "first.start", "first.n")
    listed = left.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("found"))
    contexts = Stash(open_contexts(docs.join(listed, "doc").select("id", "doc", "text", "found"), kind))
    equal.drop()
    release(spark)
    parts, tables, more = small_groups(contexts, kind, later)
    out = [whole.df, *more]
    if kind is Bytes:
        size = contexts.df.agg(F.sum(F.length("content"))).first()[0] or 0
        family = SuffixArrays(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
        every = unite_all(parts)
        for k in range(BATCHES):
            tables.append(family.add(every.where(F.pmod(F.xxhash64("doc"), F.lit(BATCHES)) == k)))
            out.append(tables[-1].df)
            release(spark)
        family.drop()
    else:
        out.append(seed_and_extend(unite_all(parts)))
    done = Stash(unite_all(out).groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("found")))
    for s in [whole, *tables]:
        s.drop()
    release(spark)
    return done.df, [done]


def unite_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


Found = dict[str, np.ndarray]


def covered(size: int, window: int, found: Found) -> np.ndarray:
    """Which units lie in a listed window."""
    start, n = found["start"], found["n"]
    step = np.bincount(start, minlength=size + 1) - np.bincount(np.minimum(size, start + n + window - 1), minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def doc_key(id_col: str, text_col: str) -> Column:
    """A hash of id and text: rows that share an id, or have none, but differ in their texts are different documents."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), doc_key(id_col, text_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def digests(docs: DataFrame, kind: Kind, later: bool, columns: list[str], measure: Callable[[str, Found], tuple]) -> DataFrame:
    prepare(docs.sparkSession)
    found, _ = repeated_stretches(docs, kind, later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t, f) for t, f in zip(b.column(1).to_pylist(), lists(b.column(2)), strict=True)]
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * (len(columns) - 1) + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *columns])

    kinds = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in columns[:-1]), T.StructField(columns[-1], T.StringType())])
    d = docs.join(found, "doc", "left").select("id", "text", "found").mapInArrow(run, kinds)
    return d.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def remove_later_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words in a 20-word window that also starts earlier are removed.

    Earlier: in a document with a smaller id, or before in the same document; judged on the input. Texts
    of under 20 words, empty and null ones lose nothing. Rows that repeat an id and text don't precede each
    other; rows of one id with different texts precede by a hash. Null ids count as the smallest.
    """

    def measure(text: str, found: Found) -> tuple:
        words = FIND(text)
        gone = covered(len(words), Words.window, found)
        kept = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
        return len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()

    return digests(keyed(docs, id_col, text_col), Words, True, ["n_words", "n_removed", "kept_sha256"], measure)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: bytes in a 200-byte string found twice or more are removed.

    All occurrences go, the first as well; matches may overlap but never cross documents. Shorter, empty and
    null texts lose nothing. Repeated rows repeat each other.
    """

    def measure(text: str, found: Found) -> tuple:
        raw = np.frombuffer(text.encode(), np.uint8)
        gone = covered(len(raw), Bytes.window, found)
        kept = raw[~gone]
        return len(raw), int(gone.sum()), len(spans(gone)[0]), hashlib.sha256(kept.tobytes()).hexdigest()

    return digests(keyed(docs, id_col, text_col), Bytes, False, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], measure)


def without_spans(text: str, found: Found) -> str:
    """The text without its repeated bytes; characters that are only partly repeated stay."""
    if not text or not len(found["start"]):
        return text
    raw = np.frombuffer(text.encode(), np.uint8)
    gone = covered(len(raw), Bytes.window, found)
    first = (raw & 0xC0) != 0x80
    number = np.cumsum(first) - 1
    whole = np.ones(number[-1] + 1, bool)
    np.logical_and.at(whole, number, gone)
    return raw[~whole[number]].tobytes().decode()


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with repeated 200-byte strings taken out of their texts, all columns, of whatever names, kept.

    Ids are integers or null; a null text stays null. chars_col, if there, is set to the new length of changed texts.
    """
    prepare(docs.sparkSession)
    found, _ = repeated_stretches(keyed(docs, id_col, text_col), Bytes, False)
    key, hit = fresh(docs, "_sq_doc"), fresh(docs, "_sq_found")
    d = docs.withColumn(key, doc_key(id_col, text_col)).join(found.select(F.col("doc").alias(key), F.col("found").alias(hit)), key, "left")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns[:-1])
            found = list(lists(b.column(len(cols))))
            texts = b.column(at).to_pylist()
            new = [t and without_spans(t, f) for t, f in zip(texts, found, strict=True)]
            cols[at] = pa.array(new, pa.string())
            if chars_col in names:
                k = names.index(chars_col)
                old = cols[k].to_pylist()
                cols[k] = pa.array([len(t) if t is not None and len(f["start"]) else n for t, f, n in zip(new, found, old, strict=True)], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return d.select(*names, hit).mapInArrow(run, docs.schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
