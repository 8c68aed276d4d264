"""The index of suffix arrays, extension and lengthened keys against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from sequor.llm import repeats
from sequor.llm.common import join_counted
from tests.conftest import SF
from tests.llm.test_corpus import WORDS, by_id, later_words, repeated_bytes


def runs_and_contexts(kind, texts):
    """Rows of CONTEXT of all runs, and the windows that each context's windows are, by brute force."""
    rows = []
    for d, t in enumerate(texts):
        u = kind.units(t)
        for anchor, _, start, n in repeats.runs_of(kind, u):
            grams = kind.grams(kind.base(u))
            for a, s, m in zip(anchor, start.tolist(), n.tolist(), strict=True):
                at = int((grams[s : s + kind.window - kind.gram + 1] == a).argmax())
                rows.append((int(np.array(a, np.uint64).view(np.int64)), d, d, s, m, at, bytearray(u[s : s + m + kind.window - 1].tobytes())))
    return rows


def patched_texts(seed, n=30):
    """Texts cut from a few sources, so that matches of all lengths overlap."""
    rnd = random.Random(seed)
    sources = ["".join(rnd.choice("ab cd.") for _ in range(900)) for _ in range(3)] + ["x" * 500, "ab" * 300]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rnd.randint(1, 4)):
            s = rnd.choice(sources)
            lo = rnd.randrange(len(s))
            t += s[lo : lo + rnd.randint(1, 450)] + rnd.choice(["", "#", "é"])
        out.append(t)
    return out


@pytest.mark.parametrize(("seed", "sizes"), [(2, [1] * 4 + [26]), (3, [20, 6, 2, 1, 1])])
def test_family_equals_brute_force_for_any_batches(spark, seed, sizes):
    texts = patched_texts(seed)
    rows = runs_and_contexts(repeats.Bytes, texts)
    family, hits, most, at = repeats.SuffixArrays(spark, 5), Counter(), 0, 0
    order = list(range(30))
    random.Random(seed).shuffle(order)
    for size in sizes:
        of = set(order[at : at + size])
        at += size
        for r in family.add(spark.createDataFrame([r for r in rows if r[2] in of], repeats.CONTEXT)).df.collect():
            hits.update((r.doc, r.start + k) for k in range(r.n))
        most = max(most, len(family.levels))
        stored = [n for _, n in family.levels]
        assert all(a > b for a, b in zip(stored, stored[1:], strict=False)) and sum(stored) == sum(r[2] in set(order[:at]) for r in rows)
    raws = [t.encode() for t in texts]
    count = Counter(r[s : s + 200] for r in raws for s in range(len(r) - 199))
    assert set(hits) == {(d, s) for d, r in enumerate(raws) for s in range(len(r) - 199) if count[r[s : s + 200]] > 1}
    for k, (table, n) in enumerate(family.levels):  # every level is in the order of its suffixes
        got = table.df.where("hit = false").collect()
        assert len(got) == n
        for a, b in zip(*(sorted(got, key=lambda r: (hash_bucket(spark, r.key), r.place))[x:] for x in (0, 1)), strict=False):
            if hash_bucket(spark, a.key) == hash_bucket(spark, b.key):
                assert (a.key % (1 << 64), bytes(a.content[a.at :])) <= (b.key % (1 << 64), bytes(b.content[b.at :]))
    if len(sizes) > 4:
        assert most > 1
    family.drop()


BUCKETS: dict[int, int] = {}


def hash_bucket(spark, key):
    if key not in BUCKETS:
        BUCKETS[key] = spark.sql(f"SELECT pmod(xxhash64({key}L), 5)").first()[0]
    return BUCKETS[key]


def test_more_than_one_level_is_scanned(spark, monkeypatch):
    seen = []
    add = repeats.SuffixArrays.add

    def spy(self, batch):
        out = add(self, batch)
        seen.append([n for _, n in self.levels])
        return out

    monkeypatch.setattr(repeats.SuffixArrays, "add", spy)
    repeats.op7_suffix_dedup(spark, "/root/testdata/sf0.01")
    assert len(seen) == repeats.BATCHES and max(map(len, seen)) > 1 and all(n > 0 for n in seen[-1])


@pytest.mark.parametrize(("contexts", "seed"), [(256, 5), (2, 6)])
def test_texts_of_patches(spark, monkeypatch, seed, contexts):
    monkeypatch.setattr(repeats, "CONTEXTS", contexts)
    texts = patched_texts(seed, 40)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = repeated_bytes(list(enumerate(texts)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeated_bytes(d).collect()} == want
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    sources = [[rnd.choice(vocabulary) for _ in range(150)] for _ in range(3)] + [["a"] * 60, ["a", "b", "c"] * 20]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rnd.randint(1, 4)):
            s = rnd.choice(sources)
            lo = rnd.randrange(len(s))
            words += [*s[lo : lo + rnd.randint(1, 60)], rnd.choice(vocabulary)]
        texts.append(" ".join(words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_later_words(d).collect()} == later_words(dict(enumerate(texts)))


def test_a_common_line_amid_many_texts(spark, monkeypatch):
    """One seed in hundreds of different contexts: its key is lengthened, and only equal windows go."""
    monkeypatch.setattr(repeats, "CONTEXTS", 16)
    rnd = random.Random(7)
    make = lambda n: " ".join(f"w{rnd.randint(0, 10**5)}" for _ in range(n))
    line, passage = make(12), make(45)
    texts = [f"{make(30)} {line} {make(30)}" for _ in range(300)] + [f"{make(20)} {passage} {make(20)}" for _ in range(40)]
    rnd.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_later_words(d).collect()}
    assert got == later_words(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeated_bytes(d).collect()}
    assert got == repeated_bytes(list(enumerate(texts)))


def test_all_documents_equal_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in d.collect()]
    want = repeated_bytes(docs)
    for i, (r,) in by_id(repeats.op7_suffix_dedup(spark, SF)).items():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[i]
    words = later_words(dict(docs))
    for i, (r,) in by_id(repeats.op5_substring_dedup(spark, SF)).items():
        assert (r.n_words, r.n_removed, r.kept_sha256) == words[i] and r.n_words == len(WORDS.findall(dict(docs)[i] or ""))


def test_join_counted(spark, monkeypatch):
    monkeypatch.setattr("sequor.llm.common.HEAVY_ROWS", 20)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(200)], "a long, b long")
    counted = rows.groupBy("a").count()
    assert sorted(map(tuple, join_counted(rows, counted, ["a"], "count").collect())) == sorted(map(tuple, rows.join(counted, "a").collect()))
