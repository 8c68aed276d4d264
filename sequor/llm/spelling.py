"""Spelling variants: words at distance one are found by a symmetric-delete join, and each rarer word
follows its far more frequent neighbour to a root.

A word emits itself and its distinct single deletions as 64-bit keys; equal keys meet in an equi-join and
a pair is kept if its code points differ by exactly one insertion, deletion or replacement. Keys of a
word of n code points take O(n), so that very long words are no special case.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.llm.common import Stash, cut, prepare

#: Different words that a task counts before it hands its counts on.
HELD = 1 << 18
#: Code points that are hashed at once.
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, noise: int = 0) -> DataFrame:
    """word, n: the runs of [A-Za-z\\u00C0-\\u00FF] with at least `least` code points, A-Z lower-cased, and how often they occur.

    With noise, a run whose crc32 of "<id>:<run>" is divisible by it loses the code point at crc32 % length first.
    Null texts hold no words, a null id counts as an empty string; repeated rows count as often as they are there.
    Tasks count before the shuffle, in tables of at most HELD words.
    """
    run_of = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in seen], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for key, text in zip(b.column("id").cast(pa.binary()).to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                runs = Counter(run_of.findall((text or b"").lower()))
                if noise:
                    start = zlib.crc32((key or b"") + b":")
                    for run in [r for r in runs if zlib.crc32(r, start) % noise == 0]:
                        word = run.decode()
                        at = zlib.crc32(run, start) % len(word)
                        n = runs.pop(run)
                        if len(word) > least:
                            seen[(word[:at] + word[at + 1 :]).encode()] += n
                seen.update(runs)
                if len(seen) > HELD:
                    yield flush()
        yield flush()

    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key, first and last place of each distinct deletion of words of one length, a word a row."""
    k, n = codes.shape
    with np.errstate(over="ignore"):
        power = _powers(n)
        prefix = np.zeros((k, n + 1), np.uint64)
        np.cumsum((codes + np.uint64(1)) * power, axis=1, out=prefix[:, 1:])
        gone = prefix[:, :-1] + (prefix[:, -1:] - prefix[:, 1:]) * INVERSE
    first = np.ones((k, n), bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, lo = np.nonzero(first)
    hi = np.append(lo[1:], n) - 1
    hi[np.append(row[1:] != row[:-1], True)] = n - 1
    return row, _mix(gone[row, lo], n - 1), lo, hi


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, BASE)), dtype=np.uint64)[:n]


def _mix(x: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(n) * BASE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _own(codes: np.ndarray) -> np.ndarray:
    k, n = codes.shape
    with np.errstate(over="ignore"):
        power = _powers(n)
        return _mix(((codes + np.uint64(1)) * power).sum(1, dtype=np.uint64), n)


def deletion_keys(words: DataFrame) -> DataFrame:
    """words(id, word) -> key, id, lo, hi: each word itself (lo = -1) and its distinct deletions.

    Deleting any of the places lo to hi gives the same string, as they hold one letter.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column("id").to_numpy(), np.array(b.column("word").to_pylist(), object)
            length = np.array([len(w) for w in text])
            for n in np.unique(length):
                group = np.flatnonzero(length == n)
                for at in range(0, len(group), step := max(1, BLOCK // max(1, int(n)))):
                    g = group[at : at + step]
                    codes = np.frombuffer("".join(text[g]).encode("utf-32-le"), np.uint32).reshape(len(g), n).astype(np.uint64)
                    row, key, lo, hi = _keys(codes) if n else (np.zeros(0, np.int64),) * 4
                    none = np.full(len(g), -1, np.int32)
                    columns = (np.concatenate([_own(codes), key]), np.concatenate([ids[g], ids[g][row]]), np.concatenate([none, lo.astype(np.int32)]), np.concatenate([none, hi.astype(np.int32)]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "lo", "hi"])

    return words.select("id", "word").mapInArrow(emit, "key long, id long, lo int, hi int")


def _without(word: Column, place: Column) -> Column:
    return F.concat(F.substr(word, F.lit(1), place), F.substr(word, place + 2))


def near_pairs(words: DataFrame) -> DataFrame:
    """words(id, word, n) -> id, word, n, other, other_word, other_n: each pair of different words at distance one, once.

    A longer word is on the other side. Of words of one length, those meet that lose the same place; a key
    has at most one word for each letter and place, so a group of equal keys is bounded by the alphabet.
    The joins are hinted: keys are sized as the compressed words that they are made of, a small part of what they hold, and
    would be sent to the driver and all tasks.
    """
    k = deletion_keys(words)
    a, b = k.alias("a"), k.alias("b")
    shorter = (F.col("a.lo") < 0) & (F.col("b.lo") >= 0)
    same = (F.col("a.lo") >= 0) & (F.col("a.id") < F.col("b.id")) & (F.greatest("a.lo", "b.lo") <= F.least("a.hi", "b.hi"))
    met = a.join(b.hint("merge"), F.col("a.key") == F.col("b.key")).where(shorter | same)
    met = met.select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.when(F.col("a.lo") >= 0, F.greatest("a.lo", "b.lo")).alias("place"), F.col("b.lo").alias("lo"))
    d = met.join(words.select("id", "word", "n").hint("merge"), "id")
    d = d.join(words.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n")).hint("merge"), "other")
    left = F.when(F.col("place").isNull(), F.col("word")).otherwise(_without(F.col("word"), F.col("place")))
    right = _without(F.col("other_word"), F.coalesce("place", "lo"))
    return d.where((left == right) & (F.col("word") != F.col("other_word"))).drop("place", "lo")


def group_variants(counts: DataFrame, factor: int = 5) -> DataFrame:
    """counts(word, n) -> word, n, n_near, form, form_n, root.

    n_near counts the words at distance one. form is the one of them with the largest n, the smallest in code-point order on
    ties, if its n is at least factor times the word's, else null; root is the end of the chain of forms, or the
    word itself. Null words are left out; rows of one word are added up; an empty table gives an empty result. A chain has
    at most log(largest n) / log(factor) steps, and each round halves what is left of it.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more: chains of forms have to rise")
    prepare(counts.sparkSession)
    table = counts.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")).select(F.monotonically_increasing_id().alias("id"), "word", "n")
    kept = [Stash(table)]
    words = kept[0].df
    try:
        pairs = near_pairs(words)
        left, right = ("id", "word", "n"), ("other", "other_word", "other_n")
        # A pair is read from both ends; ids are numbered once, so each end meets its word.
        ends = pairs.select(F.explode(F.array(F.struct(*_end(left, right)), F.struct(*_end(right, left)))).alias("e")).select("e.*")
        best = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("to").alias("to"))
        d = words.join(best, "id", "left").withColumn("form_n", -F.col("to.less"))
        rises = F.col("form_n") >= factor * F.col("n")
        d = d.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(rises, F.col("to.word")).alias("form"), F.when(rises, F.col("form_n")).alias("form_n"), F.when(rises, F.col("to.id")).alias("up"))
        kept.append(Stash(d))
        found = kept[1].df
        chain = found.where("up is not null").select("id", "up")
        while True:
            ahead = chain.select(F.col("id").alias("up"), F.col("up").alias("next"))
            chain = cut(chain.join(ahead.hint("merge"), "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
            if chain.where("moved").isEmpty():
                break
            chain = chain.drop("moved")
        roots = chain.join(words.select(F.col("id").alias("up"), F.col("word").alias("root")).hint("merge"), "up").select("id", "root")
        return cut(found.drop("up").join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    finally:
        for t in kept:
            t.drop()


def _end(here: tuple[str, str, str], there: tuple[str, str, str]) -> list[Column]:
    return [F.col(here[0]).alias("id"), F.struct((-F.col(there[2])).alias("less"), F.col(there[1]).alias("word"), F.col(there[0]).alias("id")).alias("to")]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), noise=199)
    return group_variants(counts.where("n >= 5")).select("word", "form", "root", "n", "n_near", "form_n")
