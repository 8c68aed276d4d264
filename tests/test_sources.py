import gzip

import numpy as np
import pytest

from sequor.sources import sinks, text, tfrecord


def put(path, data, gz=False):
    path.write_bytes(gzip.compress(data.encode()) if gz else data.encode())
    return str(path)


@pytest.mark.parametrize("gz", [False, True])
def test_bed_and_fasta_whatever_the_name(spark, tmp_path, gz):
    b = put(tmp_path / "a.bed", "#c\nchr7\t0\t2000\nchr7\t4000\t4500\tn\t1\t-\tx\ty\n\n", gz)
    rows = text.read_bed(spark, b, sniff=True).orderBy("start_pos").collect()
    assert [(r.start_pos, r.strand, r.extra) for r in rows] == [(0, None, None), (4000, "-", ["x", "y"])]
    assert text.is_gzipped(spark, b).first().gzipped == gz
    f = put(tmp_path / "a.fa", ">one x\nacg\n\nTT\n>two\nGG\n>two\nCC\n>none\n", gz)
    got = [(r.name, r.seq) for r in text.read_fasta(spark, f).orderBy("rec_no").collect()]
    assert got == [("one x", "ACGTT"), ("two", "GG"), ("two", "CC"), ("none", "")]
    assert {(r.name, r.seq) for r in text.last_by_name(text.read_fasta(spark, f)).collect()} == {("one x", "ACGTT"), ("two", "CC")}


def test_genome_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {f"chr{k}": "".join(rng.choice(list("ACGTacgt"), n)) for k, n in enumerate((5000, 3, 0, 12000, 64, 900))}
    lines = "\n".join(line for c, s in want.items() for line in [f">{c} x", *(s[k : k + 61] for k in range(0, len(s), 61)), ""])
    whole = put(tmp_path / "g.fa", f"{lines}\n>long\n{'ACGT' * 500}\n")
    want["long"] = "ACGT" * 500
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "5000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = {}
            for r in text.read_genome(spark, whole, 64).orderBy("chrom", "tile").collect():
                assert len(got.get(r.chrom, "")) == 64 * r.tile
                got[r.chrom] = got.get(r.chrom, "") + r.part
            assert got == {c: s.upper() for c, s in want.items() if s}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_files(spark, tmp_path):
    s = put(tmp_path / "s.txt", "a  /x/a.bed\nb\t/x/b.bed\n")
    assert [(r.target_idx, r.label) for r in text.read_sample_sheet(spark, s, 3).orderBy("target_idx").collect()] == [(3, "a"), (4, "b")]
    with pytest.raises(Exception, match="label and a path"):
        text.read_sample_sheet(spark, put(tmp_path / "t.txt", "a b c\n")).collect()
    z = put(tmp_path / "z.txt", "chr1 100\nchr2\t50\n")
    assert {(r.chrom, r.length) for r in text.read_chrom_sizes(spark, z).collect()} == {("chr1", 100), ("chr2", 50)}
    a = put(tmp_path / "act.txt", "\tx\ty\nr1\t1\t0\nr2\t0\t1\n")
    got = text.read_scores(spark, a).orderBy("name").collect()
    assert [(r.name, r.scores, r.integral) for r in got] == [("r1", [1, 0], True), ("r2", [0, 1], True)]
    with pytest.raises(ValueError):
        text.read_metadata(spark, "x.txt")
    m = put(tmp_path / "m.tsv", "Query_ID\tTarget_ID\tq-value\nf0\tMA0058.1\t0.01\n# end\n")
    assert text.read_motif_hits(spark, m).first().q == 0.01
    k = put(tmp_path / "m.meme", "MEME\nletter-probability\nx\nletter-probability\n")
    assert text.count_meme_motifs(spark, k).first().n == 2


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("chr1", 5, 9, "+", [0, 2])], "chrom string, start_pos long, end_pos long, strand string, activity array<int>")
    assert sinks.merged_bed_lines(d).first().value == "chr1\t5\t9\t.\t1\t+\t0,2"
    assert sinks.activity_lines(d, 3).first().value == "chr1:5-9(+)\t1\t0\t1"
    sinks.write_lines(sinks.activity_lines(d, 3), str(tmp_path / "act"), "\ta\tb\tc")
    assert [r.value for r in spark.read.text(str(tmp_path / "act")).collect()][0] == "\ta\tb\tc"
    sinks.write_bed(d.drop("activity"), str(tmp_path / "bed"), compress=True, single=True)
    assert text.read_bed(spark, str(tmp_path / "bed")).count() == 1
    x = spark.createDataFrame([("ACG", "train"), ("TTT", "test")], "seq string, split string")
    sinks.write_dataset(x, str(tmp_path / "ds"))
    assert sinks.read_dataset(spark, str(tmp_path / "ds"), reverse_complements=True).count() == 4


def test_tfrecords_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2, (10, 20, 4)).tolist(), rng.integers(0, 2, (10, 6)).astype(float).tolist()
    d = spark.createDataFrame([(i, [float(v) for r in a for v in r], b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y array<double>")
    got = tfrecord.write_tfrecords(d, str(tmp_path / "s-{shard:03d}.tfr"), "k", "x", "y", "int32", "float32", chunk=1, first_shard=2).collect()
    assert sorted(r.shard for r in got) == list(range(2, 12))
    back = tfrecord.read_tfrecords(spark, str(tmp_path / "*.tfr"), "int32", "float32").orderBy("path").collect()
    assert [r.feature for r in back] == [[float(v) for q in a for v in q] for a in x] and [r.label for r in back] == y
    assert back[0].feature_shape == [80] and back[0].label_shape == [6]
    assert tfrecord.template_keys("foo {bar:03d} {baz}") == ["bar", "baz"]
    with pytest.raises(ValueError):
        tfrecord.write_tfrecords(d, "x", "k", "x", "y")
    assert tfrecord.crc32c(b"123456789") == 0xE3069283
