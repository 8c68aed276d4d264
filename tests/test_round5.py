"""FASTA blocks without a shuffle of lines, hashed orders, sessions merged before they are dealt, records made where they are written."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sequor.functions import seq as sq
from sequor.operators import attribution
from sequor.sources import text, tfrecord
from sequor.streaming import streams


def test_fasta_records_of_blocks_in_any_batches():
    """only what a block's borders cut, two records a block at most, is left to be put together."""
    rnd = random.Random(4)
    for _ in range(200):
        lines = [(p, b * 10, rnd.choice([">n1", ">n2", "AC", "G", "TTT"])) for p in "ab" for b in range(rnd.randint(1, 3)) for _ in range(rnd.randint(1, 7))]
        whole, rest = [], []
        for at in sorted({x[:2] for x in lines}):
            found, n = [], 0
            for v in (x[2] for x in lines if x[:2] == at):
                n += v[0] == ">"
                if v[0] == ">" or not found:
                    found.append([*at, n, v if v[0] == ">" else None, ""])
                found[-1][4] += "" if v[0] == ">" else v
            for k, r in enumerate(found):
                (whole if r[3] and k + 1 < len(found) else rest).append(tuple(r))
        step = rnd.randint(1, 6)
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines[k : k + step], strict=True)], names=["path", "_block", "_v"]) for k in range(0, len(lines), step)]
        for kind, want in ((True, whole), (False, rest)):
            got = [tuple(r.values()) for b in text.fasta_records(iter(batches), kind) for r in b.to_pylist()]
            assert sorted(got, key=str) == sorted(want, key=str)
        assert len(rest) <= 2 * len({x[:2] for x in lines})


def test_fasta_lines_are_not_dealt_out(spark, tmp_path):
    """the plan has no window over lines."""
    (tmp_path / "a.fa").write_text("".join(f">r{k} x\nac\ngt\n" for k in range(50)))
    d = text.read_fasta(spark, str(tmp_path / "a.fa"))
    assert [(r.rec_no, r.name, r.seq) for r in d.orderBy("rec_no").collect()] == [(k, f"r{k} x", "ACGT") for k in range(50)]
    assert "_line#" not in d._jdf.queryExecution().toString()


def test_orders_by_hash():
    """permutations that follow from seed, number and row key, for many rows at once."""
    keys = np.arange(6000)
    o = attribution._orders(keys, 3, 0, 5)
    assert (np.sort(o, axis=1) == np.arange(5)).all()
    assert (o[::7] == attribution._orders(keys[::7], 3, 0, 5)).all()
    assert (o != attribution._orders(keys, 3, 1, 5)).any(1).mean() > 0.9 < (o != attribution._orders(keys, 4, 0, 5)).any(1).mean()
    share = np.bincount(o @ 5 ** np.arange(5))
    assert (share > 0).sum() == 120 and share.max() < 100  # 50 of each order
    assert attribution._orders(np.array([-1, 2]), 0, 0, 0).shape == (2, 0)


def test_island_sessions_are_merged_before_the_shuffle(spark, tmp_path):
    """each task merges its rows first."""
    rows = [("chr1", k, k + 30) for k in range(0, 4000, 2)] + [("chr1", 1 << 33, (1 << 33) + 1)]
    for part in (rows[:-1], rows[-1:]):
        spark.createDataFrame(part, "chrom string, start_pos long, end_pos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("chrom string, start_pos long, end_pos long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.islands(s, 10, ["chrom"], 0).writeStream.format("memory").queryName("merged_islands").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    assert plan.index("Exchange") < plan.rindex("MergingSessions")  # a plan begins at its end
    assert [tuple(r) for r in spark.table("merged_islands").where("island < 10000").collect()] == [("chr1", 0, 4028, 2000)]


def test_tfrecords_made_where_they_are_written(spark, tmp_path):
    """expressions are the same as columns, and a folder is listed at once."""
    d = spark.range(23).select("id", F.concat(F.lit("ACGT"), F.lit("N")).alias("seq"))
    feature, label = F.flatten(sq.one_hot(F.col("seq"))), F.array(F.col("id").cast("double"))
    (tmp_path / "b").mkdir(), (tmp_path / "a").mkdir()
    tfrecord.write_tfrecords(d, str(tmp_path / "a" / "s-{shard:03d}.tfr"), "id", feature, label, chunk=5, compress=False).collect()
    tfrecord.write_tfrecords(d.select("id", feature.alias("x"), label.alias("y")), str(tmp_path / "b" / "s-{shard:03d}.tfr"), "id", "x", "y", chunk=5, compress=False).collect()
    names = sorted(p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".tfr")
    assert names == [f"s-{k:03d}.tfr" for k in range(5)]
    assert all((tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes() for n in names)
    (tmp_path / "a" / "other.txt").write_text("no record")
    back = tfrecord.read_tfrecords(spark, str(tmp_path / "a"), files="*.tfr")
    assert sorted(r.label[0] for r in back.collect()) == list(range(23))


def test_one_hot_looked_up(spark):
    """One value of each kind, by the constants that letters are looked up among."""
    d = spark.createDataFrame([("AGn",), ("",), (None,)], "s string")
    got = [r[0] for r in d.select(sq.one_hot(F.col("s"), "AG", "uniform")).collect()]
    assert got == [[[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]], [], None]
