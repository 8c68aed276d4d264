"""Best-fit packing of token sequences by length patterns (non-negative least squares)."""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequor.llm.common import Stash, gapless_rank, prepare

#: Parts held in one generation, and two generations at once; about 170 bytes each, 200 MB a worker at most.
CACHE_WORDS = 600_000
TAIL = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Tokens that a pattern may leave empty.
SLACK = 8
#: Patterns that steps are taken among between two pricings of all, and how many rounds of steps.
POOL, POOL_ROUNDS = 20_000, 12
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCodec:
    """Token ids of text by a pre-tokenizer that never joins across spaces or line ends.

    The ids of a text are those of its space- or newline-separated parts, so parts are encoded
    once and held as little-endian bytes. Capitals A-Z are lowered first, as the tokenizer itself
    does (unless a special token's mark could arise), and final ASCII punctuation after a letter
    a-z is a part of its own. Two generations of bounded tables hold the parts in use.
    """

    held: dict[str, WordCodec] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # several workers share a machine: one thread each
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordCodec:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Words of letters alone are one pre-token and end with an end-of-word
        token, so they are encoded a hundred at a time and cut there."""
        out: list[bytes] = [b""] * len(words)
        single, text = [], []
        for k, w in enumerate(words):
            t = w.decode()
            if t.isalpha() and (t.isascii() or unicodedata.normalize("NFC", t).lower().isalpha()):
                single.append(k)
                text.append(t)
            elif t:
                out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        lines = [" ".join(text[k : k + 100]) for k in range(0, len(text), 100)]
        for n, e in enumerate(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            got = np.array(e.ids, "<u4")
            raw, at = got.tobytes(), 0
            cuts = ((np.flatnonzero(self.ends[got]) + 1) * 4).tolist()
            for k, c in zip(single[n * 100 : n * 100 + 100], cuts, strict=True):
                out[k] = raw[at:c]
                at = c
        return out

    def learn(self, new: set[bytes]) -> None:
        for w in [w for w in new if w in self.older]:
            self.words[w] = self.older[w]
            new.discard(w)
        tailed = {}
        for w in new:
            stem = w.rstrip(TAIL)
            if stem and stem != w and 97 <= stem[-1] <= 122 and b"<|" not in w:
                tailed[w] = (stem, w[len(stem) :])
        stems = new.difference(tailed).union(*tailed.values()) if tailed else new
        found = {}
        for w in stems:
            x = self.words.get(w)
            if x is None:
                x = self.older.get(w)
            if x is not None:
                found[w] = x
        rest = list(stems.difference(found))
        for k in range(0, len(rest), 20_000):
            some = rest[k : k + 20_000]
            found.update(zip(some, self.ids(some), strict=True))
        self.words.update(found)
        for w, (stem, tail) in tailed.items():
            self.words[w] = found[stem] + found[tail]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for k in range(0, len(texts), 250):
            raw = [(t or "").encode() for t in texts[k : k + 250]]
            parts = [(r if b"<|" in r else r.lower()).replace(b"\n", b" ").split(b" ") for r in raw]
            words = set().union(*parts)
            if len(self.words) + len(words) > CACHE_WORDS:
                self.words, self.older = {}, self.words
            if new := words.difference(self.words):
                self.learn(new)
            get = self.words.__getitem__
            for p in parts:
                yield b"".join(map(get, p))


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordCodec.of(path)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(codec.encode(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for p, s in enumerate(range(0, n, capacity)):
                    part = ids[4 * s : 4 * (s + capacity)]
                    at.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids_of = b.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_up, schema)


def patterns_of(present: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of up to three present lengths that leave at most SLACK tokens: rows of falling lengths, 0 for none.

    For every two lengths the largest third one that still fits; so all patterns that fill a sequence are among them. Lengths may
    repeat. At most about capacity ** 2 / 12 patterns, whatever the input.
    """
    there = np.zeros(capacity + 1, bool)
    there[present] = True
    largest = np.maximum.accumulate(np.where(there, np.arange(capacity + 1), 0))
    alone = present[present >= capacity - SLACK]
    out = [np.stack([alone, np.zeros_like(alone), np.zeros_like(alone)], 1)]
    for a in present:
        b = present[(present <= a) & (present <= capacity - a)]
        c = largest[capacity - a - b]
        ok = (c <= b) & (a + b + c >= capacity - SLACK)
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(out)


def apart(patterns: np.ndarray, size: int) -> np.ndarray:
    """Which of the patterns, taken in their order, share no length with one taken before."""
    used, take = [False] * size, []
    for k, (a, b, c) in enumerate(patterns.tolist()):
        if not (used[a] or used[b] or used[c]):
            used[a] = used[b] = used[c] = True
            used[0] = False
            take.append(k)
    return np.array(take, np.int64)


def fit_counts(patterns: np.ndarray, want: np.ndarray, rounds: int = 400, least: float = 1e-3) -> np.ndarray:
    """Non-negative least squares by column generation: repeats x >= 0 so that A x is near the histogram.

    The error of a length is divided by the root of its count. All patterns are priced by what their best step would gain; the best enter a
    pool, and steps are taken there for some rounds: the best patterns that share no length, each by the exact minimum along
    its column, down to zero at most. x has few entries beside zero, as no more patterns are used than the error asks for.
    Ends once no step gains `least`.
    """
    size = len(want)
    weight = 1 / np.maximum(want, 1.0)
    weight[0] = 0
    new = np.stack([np.ones(len(patterns), bool), patterns[:, 1] != patterns[:, 0], patterns[:, 2] != patterns[:, 1]], 1) & (patterns > 0)
    times = np.where(new, (patterns[:, :, None] == patterns[:, None, :]).sum(2), 0).astype(float)
    norm = (times**2 * weight[patterns]).sum(1)
    x, rest = np.zeros(len(patterns)), want.astype(float)
    rest[0] = 0

    def gains(some: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        g = (times[some] * (weight * rest)[patterns[some]]).sum(1)
        step = np.maximum(g / norm[some], -x[some])
        return step, step * (2 * g - step * norm[some])

    while rounds > 0:
        gain = gains(slice(None))[1]
        top = gain.max(initial=0.0)
        if top <= least:
            break
        pool = np.flatnonzero(gain >= top / 20)
        pool = pool[np.argsort(-gain[pool], kind="stable")[:POOL]]
        for _ in range(POOL_ROUNDS):
            rounds -= 1
            step, gain = gains(pool)
            top_now = gain.max()
            if top_now <= max(least, top / 10):
                break
            some = np.flatnonzero(gain >= 0.3 * top_now)
            some = some[np.argsort(-gain[some], kind="stable")]
            some = some[apart(patterns[pool[some]], size)]
            cols, step = pool[some], step[some]
            x[cols] += step
            for k in range(3):
                np.subtract.at(rest, patterns[cols, k], times[cols, k] * step)
    return x


def pack_residual(left: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: equal bins are held as one entry with a count."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    caps: list[int] = []

    def put(cap: int, items: tuple[int, ...], n: int) -> None:
        if n:
            if not room[cap]:
                k = bisect_left(caps, cap)
                if k == len(caps) or caps[k] != cap:
                    caps.insert(k, cap)
            room[cap].append((items, n))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            k = bisect_left(caps, size)
            while k < len(caps) and not room[caps[k]]:
                caps.pop(k)
            if k == len(caps):
                cap, items, bins = capacity, (), n
            else:
                cap = caps[k]
                items, bins = room[cap].pop()
            each = min(cap // size, n)
            full = min(bins, n // each)
            put(cap - each * size, (*items, *[size] * each), full)
            n -= full * each
            bins -= full
            if n and n < each and bins:
                put(cap - n * size, (*items, *[size] * n), 1)
                n, bins = 0, bins - 1
            if items:
                put(cap, items, bins)
    out = []
    for entries in room.values():
        for items, n in entries:
            c: dict[int, int] = defaultdict(int)
            for s in items:
                c[s] += 1
            out.append((tuple(c.items()), n))
    return out


def pattern_plan(histogram: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """The patterns with their rounded repeats, as far as the histogram has the lengths, and what is left of it."""
    want = np.zeros(capacity + 1)
    for k, n in histogram.items():
        want[k] = n
    left = {k: int(n) for k, n in histogram.items() if n}
    patterns = patterns_of(np.flatnonzero(want), capacity)
    x = fit_counts(patterns, want)
    plan: Plan = []
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        c: dict[int, int] = defaultdict(int)
        for s in patterns[k]:
            if s:
                c[int(s)] += 1
        n = min([round(x[k]), *(left[s] // m for s, m in c.items())])
        if n > 0:
            plan.append((tuple(c.items()), int(n)))
            for s, m in c.items():
                left[s] -= m * n
    return plan, {s: n for s, n in left.items() if n}


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """(pattern as ((length, times), ...), repeats): patterns by least squares, then the residual by best-fit decreasing.

    If the residual leaves room for a sequence or more, the least used patterns, a tenth of the sequences at a time and three at
    most, are given back to it; the plan with the fewest sequences stands.
    """
    plan, left = pattern_plan(histogram, capacity)
    least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    best: Plan | None = None
    for _ in range(4):
        whole = plan + pack_residual(left, capacity)
        if best is None or sum(n for _, n in whole) < sum(n for _, n in best):
            best = whole
        if sum(n for _, n in best) <= least:
            break
        back = sum(n for _, n in plan) // 10
        plan, left = list(plan), dict(left)
        while plan and back > 0:
            pattern, n = plan.pop()
            back -= n
            for s, m in pattern:
                left[s] = left.get(s, 0) + m * n
    return best or []


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut documents into pieces of at most `capacity` tokens and pack the pieces into sequences.

    The driver sees only the histogram of piece lengths (at most `capacity` rows) and the plan made
    from it; each piece finds its place by its rank among the pieces of its length. A null or empty
    text is the end token alone. Repeated ids are rows like any other. Empty table: empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = Stash(token_pieces(docs, id_col, text_col, path or vocabulary("word_bpe_49k.json"), capacity, end_id)).df
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    first: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in make_plan(histogram, capacity):
        offset = 0
        for size, times in pattern:
            rows.append((size, first[size], times, sequence, offset))
            first[size] += n * times
            offset += size * times
        sequence += n
    ranked = gapless_rank(pieces, "length", F.struct("doc_id", "piece"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank", salts=64)
    return place(ranked, rows)


def place(ranked: DataFrame, slots: list[tuple[int, ...]]) -> DataFrame:
    """Give each (length, rank) its sequence and offset.

    The plan's entries, at most a few for each of `capacity` lengths, are sorted and searched
    in an Arrow function: a fixed-size table sent with the code.
    """
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    big = np.int64(1) << np.int64(48)
    keys = table[:, 0] * big + table[:, 1]
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in schema.fields]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            t = table[np.searchsorted(keys, size * big + rank, "right") - 1] if len(table) else np.ones((len(size), 5), np.int64)
            k = rank - t[:, 1]
            new = {"sequence_id": pa.array(t[:, 3] + k // t[:, 2]), "offset": pa.array(t[:, 4] + size * (k % t[:, 2]))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names=names)

    return ranked.mapInArrow(find, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
