import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequor import fixtures as fx
from sequor.functions import seq as sq
from sequor.functions.models import Linear, LinearClasses, Logistic, MotifScan, get_model
from sequor.operators import attribution, balance, genome, intervals, metadata, metrics, split
from sequor.plans import pipelines
from tests.conftest import SF


def bed(spark, rows):
    return spark.createDataFrame([(i, "chr7", s, e, "+") for i, (s, e) in enumerate(rows)], "peak_id long, chrom string, start_pos long, end_pos long, strand string")


ROWS = [(0, 2000), (4000, 4500), (20000, 20001)]


def test_length_and_resize(spark):
    b = bed(spark, ROWS)
    assert [r.peak_id for r in intervals.max_length(b, 1000).orderBy("peak_id").collect()] == [1, 2]
    got = lambda w: [(r.start_pos, r.end_pos) for r in intervals.resize(b, w).orderBy("peak_id").collect()]
    assert got(1000) == [(500, 1500), (3750, 4750), (19500, 20500)]
    assert got(100) == [(950, 1050), (4200, 4300), (19950, 20050)]
    with pytest.raises(ValueError):
        intervals.resize(b, 0)


def test_overlap_joins_match_brute_force(spark):
    rnd = random.Random(1)
    a, b = ([(s, s + rnd.randint(0, 3000)) for s in (rnd.randint(0, 60000) for _ in range(150))] for _ in range(2))
    hit = lambda x, y: x[0] < y[1] and y[0] < x[1] and x[0] < x[1] and y[0] < y[1]
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if hit(x, y))
    A, B = bed(spark, a), bed(spark, b)
    got = sorted((r.peak_id, r.b_peak_id) for r in intervals.overlap_join(A, B).collect())
    assert got == want
    anti = sorted(r.peak_id for r in intervals.intersect(A, B, "peak_id", nonoverlap=True).collect())
    assert anti == sorted(set(range(150)) - {i for i, _ in want})
    assert intervals.intersect(A, B, "peak_id").count() == len(want)


def greedy_by_hand(points, length, overlap):
    """Sorted sweep into islands, then repeated merging of the closest neighbours."""
    out, open_end, group = [], None, []
    for s, e, t in sorted(points, key=lambda x: (x[0], x[1], sorted(x[2]))):
        if open_end is None or open_end - overlap <= s:
            out.append(group)
            group, open_end = [], e
        group.append((s, e, t))
        open_end = max(open_end, e)
    out.append(group)
    done = []
    for g in filter(None, out):
        while len(g) > 1:
            best = max(range(len(g) - 1), key=lambda k: (g[k][1] - g[k + 1][0], -k))
            if g[best][1] - g[best + 1][0] < overlap:
                break
            (s1, e1, t1), (s2, e2, t2) = g[best], g[best + 1]
            w1, w2 = len(t1) + 1, len(t2) + 1
            mid = int(0.5 + (w1 * ((s1 + e1) // 2) + w2 * ((s2 + e2) // 2)) / (w1 + w2))
            s = max(0, mid - length // 2)
            g[best : best + 2] = [(s, s + length, t1 | t2)]
        done += g
    return sorted((s, e, tuple(sorted(t))) for s, e, t in done)


def test_greedy_merge_matches_brute_force_and_any_layout(spark):
    rnd = random.Random(2)
    raw = [(m, m + 1, k % 5) for k, m in enumerate(rnd.randint(0, 30000) for _ in range(400))]
    df = spark.createDataFrame([("chr1", s, e, "+", t) for s, e, t in raw], "chrom string, start_pos long, end_pos long, strand string, target_idx int")
    points = [(max(0, s - 100), max(0, s - 100) + 200, frozenset([t])) for s, _, t in raw]
    want = greedy_by_hand(points, 200, 50)
    for parts in (1, 7):
        got = sorted((r.start_pos, r.end_pos, tuple(r.activity)) for r in pipelines.multi_task(df.repartition(parts), 200, 50).collect())
        assert got == want
    assert {t for _, _, a in want for t in a} == {0, 1, 2, 3, 4}


def test_extend_clamps(spark):
    b = bed(spark, [(10, 11), (990, 991), (500, 501)])
    sizes = spark.createDataFrame([("chr7", 1000)], "chrom string, length long")
    assert [(r.start_pos, r.end_pos) for r in intervals.extend(b, 100, sizes).orderBy("peak_id").collect()] == [(0, 100), (900, 1000), (450, 550)]


def test_sequences(spark):
    d = spark.createDataFrame([(0, "ABCD"), (1, "ADDCCBN"), (2, "DACDGAEn"), (3, "ABBA")], "i int, seq string")
    assert [r.i for r in sq.drop_n(d).orderBy("i").collect()] == [0, 3]
    e = spark.createDataFrame([("ABCD",), ("DCBA",), ("AABD",)], "seq string")
    x = sq.one_hot_equal_length(e, alphabet="ABCD")
    assert [r.t for r in x.select(sq.decode(F.col("x"), "ABCD").alias("t")).collect()] == ["ABCD", "DCBA", "AABD"]
    with pytest.raises(Exception, match="differ in length"):
        sq.one_hot_equal_length(spark.createDataFrame([("DDBC",), ("GG",)], "seq string"), alphabet="BCDG").collect()
    with pytest.raises(Exception, match="outside"):
        e.select(sq.one_hot(F.col("seq"), "ACGT", "error")).collect()
    r = spark.createDataFrame([("AACGT",)], "seq string").select(sq.reverse_complement(F.col("seq")).alias("a"), sq.decode(sq.flip_one_hot(sq.one_hot(F.col("seq")))).alias("b")).first()
    assert r.a == r.b == "ACGTT"


@pytest.mark.parametrize("k", [1, 2, 3])
def test_klet_shuffle_keeps_counts(k):
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 60):
        s = "".join(rng.choice(list("ACGT"), n))
        t = sq.klet_shuffle_one(s, k, rng)
        words = lambda x: collections.Counter(x[i : i + k] for i in range(len(x) - k + 1))
        assert words(s) == words(t)


def test_get_sequences_drops_what_leaves_the_chromosome(spark):
    g = spark.createDataFrame([("chr7", "ACGT" * 300)], "chrom string, seq string")
    b = bed(spark, [(0, 8), (1190, 1200), (1195, 1205), (-5, 5), (510, 1030)])
    got = {r.peak_id: r.seq for r in genome.get_sequences(b, genome.tile(g, 512), "peak_id", 512).collect()}
    assert got == {0: "ACGTACGT", 1: ("ACGT" * 300)[1190:], 4: ("ACGT" * 300)[510:1030]}


def test_nearest_count_matches_brute_force(spark):
    rnd = random.Random(3)
    a, b = [rnd.randint(0, 40) for _ in range(60)], [rnd.randint(5, 35) for _ in range(12)]
    df = lambda v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i long, gc int")
    got = {r.gc: r.nearest for r in balance.nearest_counts(df(a), df(b)).collect()}
    assert got == {x: min(b, key=lambda y: (abs(x - y), -y)) for x in a}


def test_splits(spark):
    d = spark.range(1000).withColumnRenamed("id", "k")
    one = {r.k: r.split for r in split.by_fraction(d.repartition(1), "k", 0.7, 0.1, 5).collect()}
    seven = {r.k: r.split for r in split.by_fraction(d.repartition(7), "k", 0.7, 0.1, 5).collect()}
    assert one == seven and len(one) == 1000
    assert split.batch_round(37, 8) == 32 and split.batch_round(0, 8) == 0 and split.batch_round(5, 0) == 5
    with pytest.raises(ValueError):
        split.by_count(d, "k", 0.6, 0.6)
    c = bed(spark, ROWS).withColumn("chrom", F.lit("chr3"))
    assert {r.split for r in split.by_chromosome(c, ["chr3"], ["chr3"]).collect()} == {"test"}


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3, 12, 4))
    for m in (Linear(rng.random((12, 4))), Logistic(rng.random((12, 4))), MotifScan(rng.random((5, 4)))):
        g, e = m.gradient(x), 1e-6
        y = x.copy()
        y[:, 3, 2] += e
        assert np.allclose((m.predict(y) - m.predict(x)) / e, g[:, 3, 2], atol=1e-4)
    assert get_model("LINEAR") is Linear
    with pytest.raises(KeyError):
        get_model("none")
    d = spark.createDataFrame([(i, "ACGTACGTACGT") for i in range(5)], "i long, seq string").withColumn("x", sq.one_hot(F.col("seq")))
    w = rng.random((12, 4))
    s = attribution.saliency(d, Linear(w)).first()
    assert np.allclose(s.saliency, w)
    for f in (attribution.smoothgrad, attribution.expected_gradients):
        assert f(d, Logistic(w), "i").count() == 5
    p = attribution.perturb(d, Linear(w), eps=0.1, rate=0.1, steps=3).first()
    assert np.allclose(np.array(p.perturbed), np.array(p.x) + 0.1)
    assert attribution.add_noise(d, "i").count() == 5
    g = d.select(attribution.gumbel_softmax(F.array(F.lit(0.1), F.lit(2.0)), F.col("i")).alias("g")).first().g
    assert abs(sum(g) - 1) < 1e-9


def test_explainer_and_several_outputs(spark):
    rng = np.random.default_rng(1)
    w = rng.random((3, 6, 4))
    d = spark.createDataFrame([(i, "ACGTAC") for i in range(3)], "seq_id long, seq string").withColumn("x", sq.one_hot(F.col("seq")))
    m = LinearClasses(w)
    x = np.array(d.first().x)
    assert np.allclose(attribution.Explainer(m, 2).saliency_maps(d).first().saliency, w[2])
    assert np.allclose(attribution.Explainer(m).smoothgrad(d, 3).first().smoothgrad, w.mean(0))
    e = attribution.Explainer(m, 1)
    assert np.allclose(np.sum(e.integrated_grad(d, "zero").first().integrated), (w[1] * x).sum())
    assert e.expected_integrated_grad(d, 2).count() == 3
    with pytest.raises(ValueError):
        e.integrated_grad(d, "ones")
    one = np.array(e.mutagenesis(d).first().effect)
    norm = np.array(attribution.Explainer(m).mutagenesis(d).first().effect)
    for k in range(6):
        for a in range(4):
            y = x.copy()
            y[k] = np.eye(4)[a]
            p, q = m.predict(np.stack([x, y]))
            assert np.isclose(one[k, a], q[1] - p[1]) and np.isclose(norm[k, a], np.linalg.norm(q) - np.linalg.norm(p))
    v = attribution.predict(sq.mutants(d).withColumn("x", sq.one_hot(F.col("mutant"))), Linear(w[1]), out="score")
    for r in attribution.mutation_scores(v, "seq_id", "seq", "score").collect():
        assert np.isclose(r.effect, one[r.pos, "ACGT".index(r.nt)])
    g = Logistic(w[0])
    p = g.predict(x[None])[0]
    assert np.allclose(attribution.hessian(d, g).first().hessian, p * (1 - p) * (1 - 2 * p) * np.outer(w[0], w[0]), atol=1e-6)


def test_metrics_at_odd_scales(spark):
    rnd = random.Random(5)
    rows = [("a", int(rnd.random() < 0.3), 1e-6 * rnd.randint(0, 500)) for _ in range(3000)] + [("b", k % 2, 1e8 + k % 3) for k in range(90)] + [("c", 1, 0.5), ("c", 0, None)]
    d = spark.createDataFrame(rows, "t string, label int, score double")
    got = {r.t: r.auroc for r in metrics.auroc(d, ["t"]).collect()}
    for t in "ab":
        pos, neg = ([s for x, y, s in rows if x == t and y == v] for v in (1, 0))
        assert abs(got[t] - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-9
    assert got["c"] is None
    r = {x.t: x.pearson for x in metrics.pearson(d.where("t = 'b'"), ["t"]).collect()}
    y, s = np.array([x[1:] for x in rows if x[0] == "b"]).T
    assert abs(r["b"] - np.corrcoef(s - 1e8, y)[0, 1]) < 1e-6


def test_tiles_that_overlap(spark):
    letters = "ACGT" * 300
    g = spark.createDataFrame([("chr7", letters)], "chrom string, seq string")
    b = bed(spark, [(0, 8), (1190, 1200), (1195, 1205), (-5, 5), (500, 560), (511, 576)])
    got = {r.peak_id: r.seq for r in genome.get_sequences(b, genome.tile(g, 512, 64), "peak_id", 512, reach=64).collect()}
    assert got == {0: letters[:8], 1: letters[1190:], 4: letters[500:560], 5: letters[511:576]}
    with pytest.raises(Exception, match="longer than"):
        genome.get_sequences(bed(spark, [(0, 66)]), genome.tile(g, 512, 64), "peak_id", 512, reach=64).collect()


def test_files_of_experiments(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    f = spark.createDataFrame([("/x/a.bed.gz",), ("/x/b.bed",), ("/x/b.bed.gz",)], "path string")
    got = {r.file: r.path for r in metadata.with_files(m, f, "file").collect()}
    assert got == {"a": "/x/a.bed.gz", "b": "/x/b.bed", "c": None}


def test_single_task_balances(spark):
    p = fx.near_peaks(spark, SF)
    t = fx.tiles(spark, SF, 512)
    for how in ("nearest", "density", "uniform"):
        d = pipelines.single_task(p.where("target_idx = 0"), p.where("target_idx = 1"), t, "peak_id", 100, 1000, how, width=512)
        n = {r.label: r["count"] for r in d.groupBy("label").count().collect()}
        assert n.get(0, 0) <= n[1]


def test_streams(spark, tmp_path):
    from sequor.streaming.streams import sequence_features, windowed_counts

    e = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    e.write.mode("overwrite").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(s, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == e.count()
    f = spark.createDataFrame([("ACGN",), ("AACC",)], "seq string")
    assert [r.rc for r in sequence_features(f).collect()] == ["GGTT"]
