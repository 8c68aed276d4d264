"""Equal intervals, files of many records, and large tables cut into enough tasks."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sequor import fixtures as fx
from sequor.functions.models import LinearClasses, Logistic
from sequor.operators import attribution, compare, genome, intervals, motif
from sequor.operators.rank import smallest
from sequor.plans import pipelines
from sequor.sources import tfrecord, tfrecord_source
from sequor.streaming import streams
from tests.conftest import SF


def copies(spark, places, times, apart=1000):
    """Intervals far from one another, each so many times, with different targets."""
    d = spark.range(places * times).select(F.lit("chr1").alias("chrom"), (F.floor(F.col("id") / times) * apart).alias("start_pos"), F.array((F.col("id") % times).cast("int")).alias("activity"))
    return d.withColumn("end_pos", F.col("start_pos") + 200).repartition(7)


def test_equal_intervals_begin_one_island(spark):
    """Where a join at run time turns the rows round, equal ones come in another order the second time."""
    for places, times, apart in ((2_000, 30, 1000), (20_000, 3, 50_000)) * 3:
        d = intervals.islands(copies(spark, places, times, apart), 50, ["chrom"], ["end_pos"])
        assert d.where("island <> start_pos").count() == 0


def test_equal_intervals_merge_into_one_region(spark):
    got = intervals.greedy_merge(copies(spark, 2_000, 3), 200, 50, ["chrom"])
    assert got.count() == 2_000 and got.where(F.col("activity") != F.array(F.lit(0), F.lit(1), F.lit(2))).count() == 0


def test_scan_of_many_filters_and_lengths(spark):
    """Letters outside ASCII are letters like others, and offsets outside the window don't count."""
    seqs = {1: "ACGTACGTAC", 2: "GGG", 3: "N\U0001d49c\u00e9CCGA", 4: None, 5: "CGCG"}
    weights = [("x", 0, "C", 1.0), ("x", 1, "G", 2.0), ("x", 9, "G", 50.0), ("y", 2, "\u00e9", 0.5), ("y", 0, "A", None)]
    d = spark.createDataFrame(list(seqs.items()), "id int, seq string")
    k = spark.createDataFrame(weights, "filter string, offset int, nt string, weight double")
    found = motif.scan(d, k, "id", width=4)
    held = {(f, o, c): w or 0.0 for f, o, c, w in weights}
    want = sorted((i, p, f, sum(held.get((f, o, s[p + o]), 0.0) for o in range(4))) for i, s in seqs.items() if s for p in range(len(s) - 3) for f in "xy")
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row for each window, which held its letters and all weights
    assert motif.scan(d, k.where("false"), "id", width=4).count() == 0
    with pytest.raises(ValueError, match="two weights"):
        motif.scan(d, k.unionAll(k.limit(1)), "id")


class Small(Logistic):
    """A model that takes no more values at once than a task should hold."""

    def gradient(self, x):
        assert x.size <= attribution.AT_ONCE, x.size
        return super().gradient(x)


def test_maps_are_taken_in_batches_of_bounded_size(spark):
    d = spark.range(9_000).select("id", F.array(F.array_repeat(F.col("id") / 9000, 64)).alias("x")).coalesce(1)
    model = Small(np.array([[(k % 5 - 2) * 0.25 for k in range(64)]]))
    assert attribution.perturb(d, model).agg(F.sum("id"), F.count("perturbed")).first()[:] == (9_000 * 8_999 // 2, 9_000)
    model.gradient = lambda x: Logistic.gradient(model, x) if x.size * 64 <= attribution.AT_ONCE else 1 / 0
    assert attribution.hessian(d.limit(300), model).agg(F.sum(F.size("hessian"))).first()[0] == 300 * 64


def test_mutants_of_many_maps_at_once(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counted(LinearClasses):
        def predict(self, x):
            calls.add(1)
            return super().predict(x)

    rng = np.random.default_rng(3)
    model, maps = Counted(rng.standard_normal((2, 6, 4))), np.eye(4)[rng.integers(0, 4, (200, 6))]
    d = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(maps)], "id int, x array<array<double>>").coalesce(1)
    norm = lambda m: np.linalg.norm((model.weights * m).sum((1, 2)))
    for r in attribution.mutagenesis(d, model).collect():
        for p in range(6):
            for c in range(4):
                m = maps[r["id"]].copy()
                m[p] = np.eye(4)[c]
                assert abs(r["effect"][p][c] - (norm(m) - norm(maps[r["id"]]))) < 1e-9
    assert calls.value <= 10


def test_records_of_many_shapes_at_once():
    rng = np.random.default_rng(1)
    xs = [rng.standard_normal(s) for s in ((3,), (2, 4), (8,), (0,), (3,), ())]
    ys = [np.array([k]) for k in range(len(xs))]
    one = [tfrecord.encode_example({"feature": x.astype("float32"), "label": y.astype("int16")}) for x, y in zip(xs, ys, strict=True)]
    assert tfrecord.encode_rows(xs, ys, "float32", "int16") == one
    other = [tfrecord.encode_example({"feature": np.float32([k]), "label": np.int16([k]), "more": np.int64([k])}).replace(b"more/value", b"more/thing") for k in range(40)]
    for data in (one, one * 20, other, other + one):
        want = [tfrecord.example_row(r, "float32", "int16") for r in data]
        got = {}
        for at, columns in tfrecord.example_columns(data, "float32", "int16"):
            got |= dict(zip(at.tolist(), map(list, zip(*(c.to_pylist() for c in columns), strict=True)), strict=True))
        assert [got[k] for k in range(len(data))] == want


def test_packed_shards_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tfrecord_source, "shards", lambda folder: [(f"{folder}/shard-{k:05d}.tfr.gz", 1 << 20) for k in range(64)])
    assert 16 <= len(tfrecord_source.Reader({"path": str(tmp_path)}).partitions()) <= 64


def test_tasks_that_outlive_their_job_leave_nothing(tmp_path, monkeypatch):
    """A task may go on when its job has failed and been cleared."""
    writer = tfrecord_source.Writer({"path": str(tmp_path), "chunk": "10"}, False)
    monkeypatch.setattr(tfrecord_source.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_pydict({"feature": [[1.0]] * 25, "label": [[2.0]] * 25})
    assert len(writer.write(iter([batch])).parts) == 3

    def late():
        yield batch
        writer.abort([])
        yield batch

    with pytest.raises((RuntimeError, OSError)):
        writer.write(late())
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(RuntimeError):
        writer.write(iter([batch]))
    assert list(tmp_path.iterdir()) == []


def test_a_selection_reads_its_table_twice(spark):
    """Once for the keys, which are narrowed down several times, and once for the rows."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for p in frames:
            seen.add(len(p))
            yield p

    d = spark.range(300_000).mapInPandas(counted, "id long")
    got = smallest(d, [F.xxhash64("id"), F.col("id")], 1000)
    assert got.count() == 1000 and seen.value <= 3 * 300_000  # a checkpoint takes a second pass


def test_windows_are_cut_in_one_pass(spark):
    plan = fx.seq40(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "substr" not in plan


def test_a_stream_of_known_levels_meets_fewer_copies(spark):
    a = spark.range(500).select(F.lit("c").alias("chrom"), (F.col("id") * 700).alias("start_pos"), (F.col("id") * 700 + 900).alias("end_pos"))
    pairs = lambda d: sorted(tuple(r) for r in d.select("start_pos", "b_start_pos").collect())
    assert pairs(streams.overlaps(a, a, levels=[0])) == pairs(streams.overlaps(a, a)) != []
    with pytest.raises(Exception, match="none of the levels"):
        streams.overlaps(a.unionAll(a.limit(1).withColumn("end_pos", F.col("end_pos") + 5000)), a, levels=[0]).count()


def test_a_block_merges_all_but_its_borders():
    """Regions of one length inside an island: what lies outside holds back only those beside it."""
    rnd = np.random.default_rng(1)
    peaks = [(float(s), float(s + 1000), frozenset([int(k)])) for s, k in zip(np.sort(rnd.integers(0, 300_000, 4000)), rnd.integers(0, 7, 4000), strict=True)]
    whole = intervals.greedy_merge_island(peaks, 1000, 200, None)
    kept, pending = intervals.greedy_merge_block(peaks, 1000, 200, None, (peaks[0][1] - 50, peaks[0][0] + 450), (peaks[-1][0] + 50, peaks[-1][0] + 550))
    assert pending and len(whole) <= len(kept) < len(whole) + 60
    assert len({x for _, x in kept} & set(whole)) > len(whole) - 60


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_turned_round_not_intervals(spark):
    rng = np.random.default_rng(2)
    genome_ = {c: "".join(rng.choice(list("ACGTNacgt"), 997)) for c in ("chr1", "chr2")}
    rows = [(k, f"chr{k % 2 + 1}", int(s), int(s + n), "+-."[k % 3]) for k, (s, n) in enumerate(zip(rng.integers(-5, 1000, 400), rng.integers(0, 34, 400), strict=True))]
    df = spark.createDataFrame(rows, "id int, chrom string, start_pos long, end_pos long, strand string")
    tiles = genome.tile(spark.createDataFrame(list(genome_.items()), "chrom string, seq string"), 64, 32)
    back = str.maketrans("ACGTacgt", "TGCAtgca")
    for strand in (True, False):
        d = genome.get_sequences(df, tiles, "id", 64, strand, reach=32)
        want = {k: genome_[c][s:e][::-1].translate(back) if strand and o == "-" else genome_[c][s:e] for k, c, s, e, o in rows if 0 <= s < e <= 997}
        assert {r.id: r.seq for r in d.collect()} == want and d.schema["seq"].dataType.simpleString() == "string" and len(want) > 300
        assert ("translate(part" in plan_of(d)) == strand


def test_single_task_looks_sequences_up_once(spark):
    p = fx.near_peaks(spark, SF)
    x = pipelines.single_task(p.where("target_idx = 0"), p.where("target_idx = 1"), fx.tiles(spark, SF, 512, 128), "peak_id", 100, 1000, width=512, reach=128)
    assert x.count() > 100 and "FileScan" not in plan_of(x)


def test_pieces_are_taken_out_of_the_texts_once(spark, monkeypatch):
    monkeypatch.setattr(fx, "tile_pieces", lambda df, *_: df)
    assert "FileScan" not in plan_of(fx.tiles(spark, SF, 512, 128))


def test_no_rows_for_levels_that_the_other_side_lacks(spark, monkeypatch):
    """b's own bins are needed once more only where a has shorter intervals."""
    rows = [(k, "chr1", 137 * k, 137 * k + n) for k, n in enumerate([40, 900, 700, 40_000, 3, 1000] * 20)]
    df = spark.createDataFrame(rows, "id int, chrom string, start_pos long, end_pos long").withColumn("n", F.expr("end_pos - start_pos"))
    short, long_ = df.where("n <= 1024").drop("n"), df.where("n > 1024").drop("n")
    met, binned = [], intervals._binned
    monkeypatch.setattr(intervals, "_binned", lambda *a: met.append(binned(*a)) or met[-1])
    over = lambda a, b: {(x[0], y[0]) for x in a.collect() for y in b.collect() if x[2] < y[3] and y[2] < x[3]}
    for a, b, most in ((short, short, 2 * 2 * 100), (short, long_, 2 * 20 + 2 * 100), (long_, short, 2 * 20 + 2 * 100), (long_, long_, 2 * 2 * 20), (df.drop("n"), df.drop("n"), None)):
        got = [(r["id"], r["b_id"]) for r in intervals.overlap_join(a, b).collect()]
        assert len(got) == len(set(got)) and set(got) == over(a, b)
        assert most is None or sum(m.count() for m in met) <= most
        met.clear()


def test_motifs_are_counted_in_one_pass(spark):
    """The windows are read once for a table of shares, and the targets once for counting and aligning."""
    rows = [("a", "ACGT"), ("a", "AAGN"), ("a", "CC"), ("a", None), ("b", "TTTT"), (None, "GGGG"), (None, "GGGG")]
    d = spark.createDataFrame(rows, "motif string, w string")
    p = motif.position_probabilities(d, "motif", "w", 4)
    assert plan_of(p).count("Scan ") == 1
    got = {(r["motif"], r["pos"], r["nt"]): r["prob"] for r in p.collect()}
    for k in range(4):
        for nt in "ACGT":
            assert got["a", k, nt] == sum(w is not None and w[k : k + 1] == nt for m, w in rows if m == "a") / 4 and got["b", k, nt] == 0.25
    assert len(got) == 48
    found = compare.compare_motifs(motif.matrix_rows(p.where("motif = 'a'"), "motif"), motif.matrix_rows(p.where("motif is not null"), "motif"))
    assert found.count() == 2 and "Generate" not in plan_of(found)
