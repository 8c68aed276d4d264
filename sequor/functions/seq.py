"""Sequence functions: column expressions unless noted. Sequences are strings; positions count from 0."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACGT = "ACGT"


def has_n(seq: Column) -> Column:
    return F.upper(seq).contains("N")


def drop_n(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows whose sequence holds no N, in either case."""
    return df.where(~has_n(F.col(seq)))


def gc_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^CG]+", ""))


def gc_content(seq: Column) -> Column:
    """Share of C and G; null for an empty sequence."""
    return F.try_divide(gc_count(seq), F.length(seq))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def crop_or_pad(seq: Column, length: int, pad: str = ".") -> Column:
    """The centre `length` letters, or the sequence centred between pads; left parts are rounded down.

    The pad letter is none of the alphabet, so it encodes to zeros.
    """
    n = F.length(seq)
    left = F.floor((F.lit(length) - n) / 2).cast("int")
    padded = F.rpad(F.concat(F.repeat(F.lit(pad), F.greatest(left, F.lit(0))), seq), length, pad)
    return F.when(n >= length, F.substr(seq, F.floor((n - length) / 2).cast("int") + 1, F.lit(length))).otherwise(padded)


def one_hot(seq: Column, alphabet: str = ACGT, unknown: str = "zero") -> Column:
    """array<array<double>>: a row per letter, a column per letter of the alphabet.

    unknown: zero, uniform (1 / size each), first (as the first letter) or error.
    """
    keys = list(alphabet)
    other = {"zero": [0.0] * len(keys), "uniform": [1 / len(keys)] * len(keys), "first": [1.0] + [0.0] * (len(keys) - 1)}.get(unknown)
    const = lambda v: F.array(*map(F.lit, v))
    # A letter's row is looked up among constants.
    rows = F.array(*(const([float(k == j) for k in keys]) for j in keys))

    def row(c: Column) -> Column:
        hit = F.get(rows, F.instr(F.lit(alphabet), c) - 1)
        return F.coalesce(hit, const(other) if other is not None else F.raise_error(F.concat(F.lit("letter outside the alphabet: "), c)).cast("array<double>"))

    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), row)


def fill_unknown(seq: Column, key: Column, seed: int = 0, alphabet: str = ACGT) -> Column:
    """Upper case, letters outside the alphabet replaced by one of it drawn from seed, row key and place."""
    keys = list(alphabet)
    pick = lambda i: F.element_at(F.array(*map(F.lit, keys)), (F.floor(uniform(seed, key, i) * len(keys)) + 1).cast("int"))
    letters = F.filter(F.split(F.upper(seq), ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c, i: F.when(c.isin(keys), c).otherwise(pick(i))), "")


def one_hot_equal_length(df: DataFrame, seq: str = "seq", alphabet: str = ACGT, out: str = "x") -> DataFrame:
    """one_hot for sequences that must all have one length; fails at run time if they don't."""
    bounds = df.agg(F.min(F.length(seq)).alias("_lo"), F.max(F.length(seq)).alias("_hi"))
    ok = F.assert_true(F.col("_lo").eqNullSafe(F.col("_hi")), "sequences differ in length")
    return df.crossJoin(F.broadcast(bounds)).where(ok.isNull()).drop("_lo", "_hi").withColumn(out, one_hot(F.col(seq), alphabet))


def decode(x: Column, alphabet: str = ACGT) -> Column:
    """The letter of each row's largest entry, the first one on ties."""
    letters = F.array(*map(F.lit, alphabet))
    return F.array_join(F.transform(x, lambda r: F.element_at(letters, F.array_position(r, F.array_max(r)).cast("int"))), "")


def flip_one_hot(x: Column) -> Column:
    """Reverse complement of an encoded sequence with the letters in complementary order (ACGT)."""
    return F.reverse(F.transform(x, F.reverse))


def with_reverse_complements(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The rows, and each once more with its sequence reverse-complemented (is_rc)."""
    return df.withColumn("is_rc", F.lit(False)).unionByName(df.withColumns({seq: reverse_complement(F.col(seq)), "is_rc": F.lit(True)}))


def mutants(df: DataFrame, seq: str = "seq", alphabet: str = ACGT) -> DataFrame:
    """All single-site variants, the unchanged letter included: adds pos, nt, mutant."""
    at = F.sequence(F.lit(0), F.length(seq) - 1)
    d = df.where(F.length(seq) > 0).withColumn("pos", F.explode(at)).withColumn("nt", F.explode(F.array(*map(F.lit, alphabet))))
    return d.withColumn("mutant", F.overlay(F.col(seq), F.col("nt"), F.col("pos") + 1, F.lit(1)))


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone, not on the layout of the data."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def shuffled(seq: Column, key: Column, seed: int = 0) -> Column:
    """The letters in an order given by hashes of seed, key and place."""
    letters = F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.sort_array(letters), lambda s: s["c"]), "")


def klet_shuffle_one(seq: str, k: int, rng: np.random.Generator) -> str:
    """A random sequence with the same counts of k-letter words: an Euler walk on (k-1)-letter words.

    A random spanning tree towards the last word (loop-erased walks) fixes each word's last exit;
    the other exits are taken in random order.
    """
    m = k - 1
    if len(seq) <= k or m < 1:
        return "".join(rng.permutation(list(seq))) if m < 1 else seq
    words = [seq[i : i + m] for i in range(len(seq) - m + 1)]
    exits: dict[str, list[str]] = defaultdict(list)
    for a, b in zip(words, words[1:], strict=False):
        exits[a].append(b)
    root = words[-1]
    done, last = {root}, {}
    for w in sorted(exits):
        at = w
        while at not in done:
            last[at] = int(rng.integers(len(exits[at])))
            at = exits[at][last[at]]
        at = w
        while at not in done:
            done.add(at)
            at = exits[at][last[at]]
    for w in sorted(exits):
        final = exits[w].pop(last[w]) if w != root else None
        order = rng.permutation(len(exits[w]))
        exits[w] = [exits[w][i] for i in order] + ([final] if final is not None else [])
    at, out, used = words[0], [words[0]], defaultdict(int)
    for _ in range(len(words) - 1):
        nxt = exits[at][used[at]]
        used[at] += 1
        out.append(nxt[-1])
        at = nxt
    return "".join(out)


def klet_shuffle(df: DataFrame, key: str, seq: str = "seq", k: int = 2, seed: int = 0, out: str = "shuffled") -> DataFrame:
    """Shuffles that keep every k-letter word's count (an Arrow-batched function: inherently sequential)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [None if s is None else klet_shuffle_one(s, k, np.random.default_rng([seed, int(h) & 0xFFFFFFFF])) for s, h in zip(b[seq], b["_h"], strict=True)]
            yield b.drop(columns="_h")

    d = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    return d.mapInPandas(run, df.withColumn(out, F.lit("")).schema)
