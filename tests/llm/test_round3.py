"""Embedding whitening, spelling variants, toxicity, and helper names that clash with columns of the input."""

from __future__ import annotations

import collections
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequor.llm import spelling, toxicity, whitening
from sequor.llm.packing import pack_documents
from sequor.llm.quality import keep_good
from sequor.llm.repeats import cut_repeats
from sequor.llm.simhash import keep_one_of_each

SF = "/root/testdata/sf0.001"


# whitening


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_jacobi_finds_small_eigenvalues(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    want = np.sort(np.logspace(0, -10, d))[::-1]
    e, v = whitening.jacobi((q * want) @ q.T)
    assert np.allclose(v @ v.T, np.eye(d), atol=1e-12) and np.allclose(e, want, rtol=1e-5, atol=1e-16)
    scaled = np.logspace(0, -8, d)
    x = rng.standard_normal((400, d))
    v1 = x.T @ x / 400
    graded = whitening.jacobi(v1 * np.outer(scaled, scaled))[0]
    assert (np.diff(graded) <= 0).all() and abs(np.prod(graded / scaled**2) / np.linalg.det(v1) - 1) < 1e-9


def test_whitening_equals_numpy(spark):
    a = whitening.op11_embedding_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    src = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(src.embedding.to_list()).astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    y = x - x.sum(0) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    z = (y @ u[:, ::-1][:, :32]) / np.sqrt(e[::-1][:32])
    got = a.whitened.to_numpy().reshape(n, 32)
    assert np.abs(got * np.sign((got * z).sum(0)) - z).max() < 1e-8
    assert (a.deviation.to_numpy().reshape(n, 32) == ((n * x - x.sum(0)) ** 2).sum(1)[:, None]).all()
    assert np.allclose(a.explained.to_numpy()[:32], e[::-1][:32] / e.sum(), rtol=1e-6) and a.identity_error.max() < 1e-9 and set(a.n) == {n}


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 5.0]), (None, [0.5, -1.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, []), (8, [1.0]), (9, [1e300, 0.0]), (10, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    w = whitening.fit(df)
    got = whitening.whiten(df, w).collect()
    assert w.n == 3 and [r.id for r in got] == [1, 1, None] and all(len(r.whitened) == 2 for r in got)
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 3, df.schema)
    flat = whitening.fit(same)
    assert len(flat.values) == 0 and whitening.identity_error(same, flat) is None and [r.deviation for r in whitening.whiten(same, flat).collect()] == [0] * 3
    assert whitening.fit(df.where("false")) is None
    wide = whitening.fit(spark.createDataFrame([(1, [1e14]), (2, [0.0])], df.schema))
    exact = [r.deviation for r in whitening.whiten(spark.createDataFrame([(1, [1e14]), (2, [1e9])], df.schema), wide).collect()]
    assert exact[0] is None and wide.n == 2  # beyond a long


# spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(counts: dict[str, int], factor: int = 5) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    root = {}
    for w in counts:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {w: (form[w], root[w], counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé\U0001f600"), rng.integers(0, 7))): int(5 ** rng.integers(0, 6)) for _ in range(500)}
    long = "ab" * 3000
    words |= {long: 1000, long[:4000] + "x" + long[4001:]: 10, long[:-1]: 7, "a" * 900: 50, "a" * 901: 6, "": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect()}
    assert got == variants_by_hand(words)
    assert any(f and r not in (f, w) for w, (f, r, *_) in got.items())  # a chain of two
    assert spelling.group_variants(df.where("false")).count() == 0
    split = df.unionAll(df).withColumn("n", F.lit(2).cast("long")).where("length(word) < 3")
    assert {r.n for r in spelling.group_variants(split.unionByName(split.limit(0))).collect()} == {4}


def test_word_counts_equal_brute_force(spark):
    texts = [(7, "Straße STRASSEN naïveté naïveté ÀÉÎõü abcdef\nabcdefg x"), (None, "abcdefg " * 300), (8, None), (9, ""), (9, "abcdef×÷abc " * 50)]
    texts += [(i, f"wortlaut{'abcdefghij'[i % 10]} abcdefgh") for i in range(3000)]
    want: collections.Counter[str] = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert {r.word: r.n for r in spelling.count_words(df, noise=199).collect()} == want
    assert any(len(w) == 8 and w.startswith("wortlau") or w == "abcdefg" for w in want)


# toxicity


def test_label_model_tells_correlated_voters_from_independent_ones():
    """Three copies of one weak voter must not outweigh two good independent ones."""
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.2
    at = {v: k for k, v in enumerate(toxicity.VOTERS)}
    vote = np.zeros((len(y), len(at)), bool)
    for v in ("insults", "contempt"):
        vote[:, at[v]] = np.where(y, rng.random(len(y)) < 0.8, rng.random(len(y)) < 0.05)
    weak = np.where(y, rng.random(len(y)) < 0.5, rng.random(len(y)) < 0.3)
    for v in ("profanity", "threats", "hate"):
        vote[:, at[v]] = weak
    masks = (vote << np.arange(len(at))).sum(1)
    known = rng.random(len(y)) < 0.02
    h: dict[int, list[int]] = {}
    for m, k, t in zip(masks.tolist(), known, y, strict=True):
        h.setdefault(m, [0, 0, 0])[1 + int(t) if k else 0] += 1
    model = toxicity.LabelModel({m: tuple(c) for m, c in h.items()})
    ids = {at[v] for v in ("profanity", "threats", "hate")}
    linked = {frozenset((k, int(p))) for k, p in enumerate(model.parent) if p >= 0}
    assert sum(len(e & ids) == 2 for e in linked) == 2  # a tree joins the copies
    q = model.posterior(vote.astype(float))
    only = lambda *vs: [v for v in vs]
    row = lambda *vs: np.array([[float(v in vs) for v in toxicity.VOTERS]])
    assert model.posterior(row(*only("profanity", "threats", "hate")))[0] < 0.3 < 0.7 < model.posterior(row("insults", "contempt"))[0]
    assert abs(q.mean() - y.mean()) < 0.03 and ((q > 0.5) == y).mean() > 0.93
    assert model.accuracies["insults"] > model.accuracies["profanity"] + 0.2


def test_linear_training_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((500, 1)), rng.standard_normal((500, 4))])
    y = 1 / (1 + np.exp(-x @ np.array([0.3, 2, -1, 0, 0.5])))
    w = toxicity.train_linear(x, y, ridge=0.3)
    gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + np.array([1e-3, 0.3, 0.3, 0.3, 0.3]) * w
    assert np.abs(gradient).max() < 1e-4


def test_toxicity_held_out(spark):
    """Held-out rows of sf0.01 by their labels; labels of held-out rows change no score."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = {r.doc_id: r for r in toxicity.op13_toxicity(spark, sf).collect()}
    assert len(a) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in a.values())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(a[i].predicted, y) for i, y in truth.items() if a[i].held_out]
    assert sum(p for p, y in held if y) >= 0.8 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 0.02 * len(held)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b, _ = toxicity.score_toxicity(docs, turned)
    assert {r.id: r.score for r in b.collect()} == {i: r.score for i, r in a.items()}


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "you idiot"), (1, None), (1, ""), (2, "x " * 50_000), (2, "x " * 50_000), (3, "You are a pathetic idiot!!! worthless scum")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(3, 1), (3, None), (None, 1), (99, 1), (2, 0)], "doc_id long, toxic int")
    for labels in (none, some):
        got, _ = toxicity.score_toxicity(docs, labels)
        rows = got.collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.id is None] == [True]
    assert max(rows, key=lambda r: r.score).id in (3, None)
    assert toxicity.score_toxicity(docs.where("false"), none)[0].count() == 0


# stages


def test_stages_keep_columns_of_any_name(spark):
    """Every helper name that the operators' sources mention may be a column of the input."""
    here = Path(whitening.__file__).parent
    found = set()
    for f in ("common", "quality", "simhash", "repeats", "packing"):
        found |= set(re.findall(r'"(_[a-z]\w*)"', (here / f"{f}.py").read_text()))
    found |= {"_sq_" + x for x in re.findall(r'P \+ "(\w+)"', (here / "quality.py").read_text())}
    found |= {"f0", "doc", "found", "node", "root", "k", "_ROW"} - {"doc_id", "text"}
    names = sorted(found)
    assert {"_sq_words", "_sq_found", "_sq_hash"} <= found
    base = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    lower: set[str] = set()
    names = [n for n in names if not (n.lower() in lower or lower.add(n.lower()))]
    docs = base.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    want = tuple(range(len(names)))
    for stage in (keep_good, keep_one_of_each, cut_repeats):
        out = stage(docs)
        rows = out.select(*(F.col(f"`{n}`") for n in names)).distinct().collect()
        assert out.columns == docs.columns and [tuple(r) for r in rows] == [want], stage.__name__
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in stage(base).select("doc_id").collect())
    assert pack_documents(docs).count() == pack_documents(base).count()
