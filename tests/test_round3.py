"""Block-wise greedy merge, levels of bins, tiles from pieces, FASTA blocks, TFRecord source, motif comparison, models, streams."""

from __future__ import annotations

import gzip
import itertools
import random
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequor import fixtures as fx
from sequor.functions import models
from sequor.operators import attribution, balance, compare, genome, intervals, metadata, metrics
from sequor.operators.rank import running_total, smallest
from sequor.plans import pipelines
from sequor.sources import text, tfrecord, tfrecord_source
from sequor.streaming import streams
from tests.conftest import SF

# greedy merge


def one_by_one(peaks, length, overlap, size):
    p = list(peaks)
    while len(p) > 1:
        o = [a[1] - b[0] for a, b in itertools.pairwise(p)]
        if max(o) < overlap:
            break
        i = o.index(max(o))
        p[i : i + 2] = [intervals.merge_two(p[i], p[i + 1], length, size)]
    return p


def in_blocks(peaks, length, overlap, size, block):
    """The rounds of merge_large_islands on one island, without Spark."""
    now, shift, idle = list(peaks), 0, 0
    mid = lambda x: int((x[0] + x[1]) / 2)
    while True:
        blocks = [[x for _, x in g] for _, g in itertools.groupby(enumerate(now), lambda e: (e[0] + shift * (block // 2)) // block)]
        new, pending = [], False
        for k, b in enumerate(blocks):
            past, next_ = sum(blocks[:k], []), sum(blocks[k + 1 :], [])
            kept, p = intervals.greedy_merge_block(b, length, overlap, size, (max(x[1] for x in past), max(map(mid, past))) if past else None, (min(x[0] for x in next_), min(map(mid, next_))) if next_ else None)
            new += [x for _, x in kept]
            pending |= p
        idle, now, shift = (idle + 1 if len(new) == len(now) else 0), new, 1 - shift
        if not pending:
            return now
        if idle > 1:
            o = [a[1] - b[0] for a, b in itertools.pairwise(now)]
            if max(o) < overlap:
                return now
            i, idle = o.index(max(o)), 0
            now[i : i + 2] = [intervals.merge_two(now[i], now[i + 1], length, size)]


def some_peaks(rnd, mode, n, span, length):
    out = []
    for k in range(n):
        s = k * rnd.choice([3, 3, 4]) if mode == "tiled" else rnd.randint(0, span)
        out.append((float(s), float(s + (rnd.randint(1, 2 * length) if mode == "mixed" else length)), frozenset(rnd.sample(range(6), rnd.randint(0, 5)))))
    return sorted(out, key=lambda x: (x[0], x[1], sorted(x[2])))


@pytest.mark.parametrize("mode", ["same", "mixed", "tiled"])
def test_blocks_merge_as_one_by_one(mode):
    for seed in range(300):
        rnd = random.Random(seed)
        length, overlap, span = rnd.choice([20, 21, 50]), rnd.choice([0, 1, 5]), rnd.choice([30, 100, 400])
        peaks, size = some_peaks(rnd, mode, rnd.randint(1, 60), span, length), rnd.choice([None, span, span + length])
        want = one_by_one(peaks, length, overlap, size)
        assert intervals.greedy_merge_island(peaks, length, overlap, size) == want
        for block in (2, 5, 10):
            assert in_blocks(peaks, length, overlap, size, block) == want, (seed, block)


def test_large_islands_merge_as_small_ones(spark):
    """One island of 6000 peaks, and others, in blocks of 200 and whole; ties everywhere in one of them."""
    rnd = random.Random(1)
    rows = [("chr1", s, s + 100, [k % 7]) for k, s in enumerate(sorted(rnd.randint(0, 60_000) for _ in range(6000)))]
    rows += [("chr2", 30 * k, 30 * k + 100, [k % 3]) for k in range(900)] + [("chr3", 5, 105, [1]), ("chr3", 900, 1000, [2])]
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, activity array<int>").repartition(5)
    sizes = spark.createDataFrame([("chr1", 60_050), ("chr2", 10**6)], "chrom string, length long")
    for by_size in (None, sizes):
        got = [sorted((r.chrom, r.start_pos, r.end_pos, tuple(r.activity)) for r in intervals.greedy_merge(df, 100, 20, ["chrom"], by_size, block).collect()) for block in (200, intervals.BLOCK)]
        assert got[0] == got[1] and len(got[0]) > 100


def test_closest_pairs_are_merged_when_blocks_can_not_go_on(spark):
    """Intervals of very different lengths, which blocks of two seldom tell apart."""
    rnd = random.Random(4)
    peaks = some_peaks(rnd, "mixed", 40, 100, 20)
    df = spark.createDataFrame([("c", int(s), int(e), sorted(a)) for s, e, a in peaks], "chrom string, start_pos long, end_pos long, activity array<int>")
    got = sorted((r.start_pos, r.end_pos, tuple(r.activity)) for r in intervals.greedy_merge(df, 20, 1, ["chrom"], None, 10).collect())
    peaks = sorted(peaks, key=lambda x: (x[0], x[1], sorted(x[2])))
    want, island = [], []
    for p in [*peaks, None]:
        if p is None or (island and max(x[1] for x in island) - 1 <= p[0]):
            want += one_by_one(island, 20, 1, None)
            island = []
        if p:
            island.append(p)
    assert got == sorted((int(s), int(e), tuple(sorted(a))) for s, e, a in want)


# bins


def test_overlaps_of_any_length(spark):
    rnd = random.Random(3)
    side = lambda n: [(k, f"chr{rnd.randint(1, 2)}", s, s + rnd.choice([0, 1, 50, 1023, 1024, 1025, 40_000, 2_000_000, 200_000_000])) for k in range(n) for s in [rnd.randint(0, 3_000_000)]]
    a, b = side(150), side(150)
    make = lambda rows: spark.createDataFrame(rows, "peak_id long, chrom string, start_pos long, end_pos long")
    got = sorted((r.peak_id, r.b_peak_id) for r in intervals.overlap_join(make(a), make(b)).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[3] > x[2] and y[3] > y[2])
    assert got == want and len(want) > 1000
    long = make([(0, "chr1", 7, 240_000_000)])
    rows = intervals._binned(long, intervals.BIN, [(0, "=", k) for k in range(5)] + [(1, ">", k) for k in range(5)]).count()
    assert rows <= 2 * intervals.LEVELS
    assert intervals.overlap_join(make(a).where("false"), make(b)).count() == 0
    none = {r.peak_id for r in intervals.intersect(make(a), make(b), "peak_id", nonoverlap=True).collect()}
    assert none == {x[0] for x in a} - {p for p, _ in want}


# ranks and tiles


def test_running_totals_and_smallest(spark):
    rnd = random.Random(0)
    rows = [(rnd.choice("ab"), k, rnd.randint(0, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    want, sums = {}, {"a": 0, "b": 0}
    for g, k, v in rows:
        want[k] = sums[g]
        sums[g] += v
    assert {r.k: r.t for r in running_total(df, ["g"], ["k"], "v", "t").collect()} == want
    by = sorted(rows, key=lambda r: (r[2], r[1]))
    from sequor.operators import rank

    old = rank.FEW
    try:
        for few in (old, 100, 5):
            rank.FEW = few
            for n in (0, 1, 299, 300, 1500, 2999, 3000, 9999):
                assert {r.k for r in smallest(df, [F.col("v"), F.col("k")], n).collect()} == {r[1] for r in by[:n]}, (few, n)
            free = [F.xxhash64("k"), F.col("k")]
            assert smallest(df, free, 1234).count() == 1234
    finally:
        rank.FEW = old
    plan = balance.sample_uniform(df, 100, F.col("k"), 1)._jdf.queryExecution().toString()
    assert "Sort" not in plan


def test_tiles_from_pieces(spark):
    rng = np.random.default_rng(0)
    pieces = [(f"chr{c}", k, "".join(rng.choice(list("ACGT"), int(n)))) for c, many in ((1, 60), (2, 3), (3, 1)) for k, n in enumerate(rng.integers(0, 90, many))]
    pieces.append(("chr4", 0, "A" * 1000))
    df = spark.createDataFrame(pieces, "chrom string, k long, seq string").repartition(5)
    whole: dict[str, str] = {}
    for c, _, s in pieces:
        whole[c] = whole.get(c, "") + s
    for width, reach in ((64, 0), (64, 20), (100, 100)):
        got = {(r.chrom, r.tile): r.part for r in genome.tile_pieces(df, "k", width, reach).collect()}
        assert got == {(c, t): s[t * width : (t + 1) * width + reach] for c, s in whole.items() for t in range((len(s) + width - 1) // width)}


def test_fasta_records_over_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = [(f"r{k} x", "".join(rng.choice(list("ACGTacgt"), int(n)))) for k, n in enumerate(rng.integers(0, 400, 60))]
    body = "".join(f">{n}\n" + "".join(f"{s[i : i + 61]}\n\n" for i in range(0, len(s), 61)) for n, s in want)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.fa").write_text("skipped\n" + body)
    (tmp_path / "f" / "b.fa").write_bytes(gzip.compress(b">z\nAC\n>r0 x\nGG\n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for size in ("300", "5000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = text.read_fasta(spark, str(tmp_path / "f")).orderBy("path", "rec_no").collect()
            assert [(r.name, r.seq) for r in rows] == [(n, s.upper()) for n, s in want] + [("z", "AC"), ("r0 x", "GG")]
            assert [r.rec_no for r in rows] == [*range(60), 0, 1]
        assert {r.name: r.seq for r in text.last_by_name(text.read_fasta(spark, str(tmp_path / "f"))).collect()}["r0 x"] == "GG"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.gzipped for r in text.is_gzipped(spark, str(tmp_path / "f")).collect()) == [False, True]


# TFRecord source


def test_checksums_of_many_records():
    data = [b"", b"123456789", *(bytes([k]) * 30 for k in range(40)), *(bytes(range(k)) for k in range(50))]
    assert tfrecord.crc32c_many(data).tolist() == [tfrecord.crc32c(x) for x in data]
    raw = tfrecord.frames(data)
    assert list(tfrecord.records(raw)) == data and raw == b"".join(struct.pack("<Q", len(x)) + tfrecord.masked_many([struct.pack("<Q", len(x))]).tobytes() + x + tfrecord.masked_many([x]).tobytes() for x in data)
    for at in (3, 9, len(raw) - 2, len(raw) - 30):
        with pytest.raises(ValueError):
            list(tfrecord.records(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]))
    with pytest.raises(ValueError):
        list(tfrecord.records(raw[:-1]))


def test_tfrecord_source(spark, tmp_path):
    tfrecord_source.register(spark)
    d = spark.range(95).select(F.array(F.col("id").cast("double"), F.lit(2.5)).alias("feature"), F.array(F.col("id").cast("double")).alias("label"))
    at = str(tmp_path / "t")
    save = lambda df, mode, **o: df.write.format("tfrecord").mode(mode).options(chunk="10", **o).save(at)
    values = lambda: sorted((r.feature, r.label, r.feature_shape) for r in spark.read.format("tfrecord").load(at).collect())
    want = [([float(k), 2.5], [float(k)], [2]) for k in range(95)]
    save(d.repartition(3), "append")
    assert values() == want
    names = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert names == [f"shard-{k:05d}.tfr.gz" for k in range(len(names))]
    ordered = d.orderBy("label").coalesce(1)
    save(ordered, "overwrite", compress="false")
    first = tfrecord.frames([tfrecord.encode_example({"feature": np.array([k, 2.5], "float32"), "label": np.array([k], "float32")}) for k in range(10)])
    assert (tmp_path / "t" / "shard-00000.tfr").read_bytes() == first and len(list((tmp_path / "t").iterdir())) == 10
    save(d.limit(5), "append", compress="false")
    assert len(values()) == 100
    fail = d.repartition(4).withColumn("feature", F.when(F.get("label", 0) == 77, F.array(F.raise_error(F.lit("broken")).cast("double"))).otherwise(F.col("feature")))
    with pytest.raises(Exception, match="broken"):
        save(fail, "append")
    assert len(values()) == 100 and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_job")]
    with pytest.raises(Exception, match="missing: label"):
        save(d.select("feature"), "append")
    assert spark.read.format("tfrecord").load(str(tmp_path / "nowhere")).count() == 0


# motif comparison and models


def test_motif_p_values(spark):
    """Against all draws of target columns for a query of three columns."""
    rng = np.random.default_rng(2)
    draw = lambda n: rng.dirichlet(np.ones(4), n)
    rows = lambda named: spark.createDataFrame([(m, k, [float(v) for v in c]) for m, p in named.items() for k, c in enumerate(p)], "motif string, pos int, p array<double>")
    q, t = {"q": draw(3), "flat": np.full((3, 4), 0.25)}, {"a": draw(4), "b": draw(2)}
    t["own"] = np.vstack([draw(1), q["q"][::-1, ::-1]])
    got = {(r["query"], r["target"]): r for r in compare.compare_motifs(rows(q), rows(t), least=3).collect()}
    assert set(got) == {(a, b) for a in q for b in t}
    best = got["q", "own"]
    assert (best["offset"], best["strand"], best["overlap"]) == (0, "-", 3) and abs(best["score"] - 3) < 1e-9
    flat = got["flat", "a"]
    assert flat["score"] == 0 and flat["p_value"] == 1
    std = lambda p: compare._standard(p)
    columns = np.vstack([x for p in t.values() for x in (p, p[::-1, ::-1])])
    steps = compare._step(std(q["q"]) @ std(columns).T)
    for name in ("a", "own"):
        r = got["q", name]
        target = t[name] if r["strand"] == "+" else t[name][::-1, ::-1]
        i = np.arange(max(0, r["offset"]), min(3, r["offset"] + len(target)))
        seen = compare._step((std(q["q"])[i] * std(target)[i - r["offset"]]).sum(1)).sum()
        sums = sum(np.meshgrid(*(steps[k] for k in i), indexing="ij"))
        assert abs(r["p_value"] - (sums >= seen).mean()) < 1e-9
    assert compare.compare_motifs(rows(q).where("false"), rows(t)).count() == 0 and compare.compare_motifs(rows(q), rows(t).where("false")).count() == 0


@pytest.mark.parametrize("pool", ["mean", "max"])
def test_two_strand_scan(pool):
    rng = np.random.default_rng(5)
    m = models.ReverseComplementScan(rng.standard_normal((5, 4, 3)), rng.standard_normal(3), pool)
    x = rng.random((6, 20, 4))
    assert np.allclose(m.predict(x), m.predict(x[:, ::-1, ::-1]))
    f, b = m.strands(x)
    assert np.allclose(m.strands(x[:, ::-1, ::-1])[0], b[:, ::-1])
    for k in (None, 1):
        one = models.Output(m, k)
        g, e = one.gradient(x), 1e-6
        for at in ((0, 3, 2), (5, 19, 0), (2, 10, 1)):
            step = np.zeros_like(x)
            step[at] = e
            assert abs(g[at] - (one.predict(x + step) - one.predict(x - step))[at[0]] / (2 * e)) < 1e-5
    assert m.predict(x[:, :3]).tolist() == [[0, 0, 0]] * 6 and not m.gradient(x[:, :3]).any()
    reduced = models.Reduced(m, lambda p: np.log(np.exp(p).sum(1)))
    g = reduced.gradient(x)
    step = np.zeros_like(x)
    step[1, 7, 3] = 1e-6
    assert abs(g[1, 7, 3] - (reduced.predict(x + step) - reduced.predict(x - step))[1] / 2e-6) < 1e-5


def test_explainer_with_any_reducer(spark):
    rng = np.random.default_rng(6)
    m = models.LinearClasses(rng.standard_normal((2, 5, 4)))
    x = rng.random((3, 5, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "seq_id long, x array<array<double>>")
    explain = attribution.Explainer(m, reduce=lambda p: p[:, 0] * p[:, 1])
    got = np.array([r.saliency for r in explain.saliency_maps(df).orderBy("seq_id").collect()])
    p = m.predict(x)
    assert np.allclose(got, p[:, 1, None, None] * m.weights[0] + p[:, 0, None, None] * m.weights[1], atol=1e-6)
    e = np.array([r.effect for r in explain.mutagenesis(df).orderBy("seq_id").collect()])
    y = x[1].copy()
    y[2] = np.eye(4)[3]
    assert abs(e[1, 2, 3] - (explain.one.predict(y[None]) - explain.one.predict(x[1:2]))[0]) < 1e-9
    with pytest.raises(ValueError):
        attribution.Explainer(m, 1, reduce=lambda p: p[:, 0])


def test_near_perfect_fit_and_files_of_one_name(spark):
    d = spark.createDataFrame([(1e8 + k, 3e8 + 3 * k + (1e-3 if k == 5 else 0)) for k in range(100)], "score double, label double")
    r = metrics.r_squared_origin(d, []).first()
    x, y = (np.array([v[c] for v in d.collect()]) for c in (0, 1))
    m = (x * y).sum() / (x * x).sum()
    want = ((y - m * x) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs((1 - r.rsquare) - want) < 1e-9 * max(1, want) and 0 <= 1 - r.rsquare < 1e-6
    files = spark.createDataFrame([("/b/a.bed",), ("/a/a.bed",), ("/c/a.bed",)], "path string")
    assert [r.path for r in metadata.with_files(spark.createDataFrame([("a",)], "file string"), files, "file").collect()] == ["/a/a.bed"]


# files and streams


def test_multi_task_from_files(spark, tmp_path):
    put = lambda name, lines: (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    put("a.bed", ["#x", "chr1\t100\t200\tn\t0\t-", "chr1\t5000\t5100", "chrUn_1\t0\t10", "chrY\t0\t10"])
    with gzip.open(tmp_path / "b.bed.gz", "wt") as f:
        f.write("chr1\t5010\t5110\tn\t0\t.\nchr2\t0\t10\tn\t0\t+\n")
    put("old.bed", ["chr1\t120\t180\told\t1\t-\t0,1", "chr9\t7000\t7001\told\t1\t+\t."])
    put("old.txt", ["\tx\ty", "chr1:0-1(+)\t1\t1"])
    put("sizes", ["chr1\t100000", "chr2 900"])
    put("sheet", [f"A {tmp_path}/a.bed", f"B\t{tmp_path}/b.bed.gz", f"C {tmp_path}/b.bed.gz"])
    made = pipelines.multi_task_files(spark, str(tmp_path / "sheet"), str(tmp_path / "out"), 200, 50, str(tmp_path / "sizes"), str(tmp_path / "old.txt"), str(tmp_path / "old.bed"), ignore_y=True, ignore_auxiliary=True, valid=["chr2"], test=["chr9"])
    bed = [r.value for r in spark.read.text(made["bed"]).collect()]
    assert sorted(bed) == ["chr1\t4956\t5156\t.\t1\t+\t2,3,4", "chr1\t50\t250\t.\t1\t-\t0,1,2", "chr2\t0\t200\t.\t1\t+\t3,4", "chr9\t6900\t7100\t.\t1\t+\t"]
    lines = "".join(p.read_text() for p in sorted(Path(made["activity"]).glob("part-*"))).splitlines()
    assert lines[0] == "\tx\ty\tA\tB\tC" and "chr1:50-250(-)\t1\t1\t1\t0\t0" in lines and "chr9:6900-7100(+)\t0\t0\t0\t0\t0" in lines
    rows = {r.region: (r.label, r.split) for r in spark.read.parquet(made["dataset"]).collect()}
    assert rows["chr2:0-200(+)"] == ([0, 0, 0, 1, 1], "valid") and rows["chr9:6900-7100(+)"] == ([0] * 5, "test") and len(rows) == 4
    bare = pipelines.multi_task_files(spark, str(tmp_path / "sheet"), str(tmp_path / "out2"), 200, 50, table=str(tmp_path / "old.txt"), table_bed=str(tmp_path / "old.bed"), table_activity=False)
    assert "chr1\t50\t250\t.\t1\t-\t2" in [r.value for r in spark.read.text(bare["bed"]).collect()]


def test_island_stream_in_batches_with_late_rows(spark, tmp_path):
    """Batches along the genome give the table's islands; a row that is too late is left out, and state is dropped."""
    schema = "peak_id long, chrom string, start_pos long, end_pos long"
    rnd = random.Random(9)
    rows = [(k, f"chr{rnd.randint(1, 2)}", s, s + rnd.choice([5, 40, 90, 200])) for k, s in enumerate(rnd.randint(0, 9000) for _ in range(300))]
    batches = [[r for r in rows if r[2] // 3000 == k] for k in range(3)]
    batches[2].append((998, "chr1", 10, 60))  # later than the watermark
    batches.append([(999, "chr1", 1 << 33, (1 << 33) + 1)])
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.islands(s, 30, ["chrom"], 0).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    got = sorted((r.chrom, r.island, r.reach, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.island < 1 << 33)
    d = intervals.islands(spark.createDataFrame(rows, schema), 30, ["chrom"], ["peak_id"]).groupBy("chrom", "island").agg(F.max("end_pos").alias("reach"), F.count("*").alias("n"))
    assert got == sorted((r.chrom, r.island, r.reach, r.n) for r in d.collect())
    assert state[-1]["numRowsTotal"] <= 1 and sum(p["numRowsDroppedByWatermark"] for p in state) >= 1


def test_first_rows_stream(spark, tmp_path):
    rows = [[("a", 1, "2024-01-01 00:00:00"), ("b", 2, "2024-01-01 00:10:00"), ("a", 3, "2024-01-01 00:20:00")], [("b", 4, "2024-01-01 00:30:00"), ("c", 5, "2024-01-01 05:00:00")]]
    for b in rows:
        spark.createDataFrame(b, "k string, v int, t string").selectExpr("k", "v", "cast(t as timestamp) t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, v int, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.first_rows(s, ["k"], "t", "1 hour").writeStream.format("memory").queryName("first_rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.v) for r in spark.table("first_rows").collect()) == [("a", 1), ("b", 2), ("c", 5)]


def test_sequence_stream_equals_the_table(spark, tmp_path):
    tiles, p = fx.tiles(spark, SF, 2048, 1150), fx.near_peaks(spark, SF).limit(200).checkpoint()
    p.repartition(2).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.sequences(s, tiles, "peak_id", 2048, 1150).writeStream.format("memory").queryName("seq_rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.peak_id: r.seq for r in genome.get_sequences(p, tiles, "peak_id", 2048, reach=1150).collect()}
    assert {r.peak_id: r.seq for r in spark.table("seq_rows").collect()} == want and want
