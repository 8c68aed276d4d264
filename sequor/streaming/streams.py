"""Row-wise operators on streams, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.functions.seq import gc_count, has_n, reverse_complement
from sequor.operators.genome import get_sequences
from sequor.operators.intervals import BIN, LEVELS, level_of, overlap_join


def sequence_features(stream: DataFrame, seq: str = "seq") -> DataFrame:
    """gc, length and reverse complement of sequences without N: stateless, so it runs on streams as on tables."""
    return stream.where(~has_n(F.col(seq))).withColumns({"gc": gc_count(F.col(seq)), "length": F.length(seq), "rc": reverse_complement(F.col(seq))})


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and sums of value by tumbling window; state is dropped once the watermark has passed."""
    w = F.window(time, width)
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def session_counts(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def overlaps(stream: DataFrame, static: DataFrame, width: int = BIN, levels: list[int] | None = None) -> DataFrame:
    """Every pair of a stream's interval and an overlapping one of a table: a stateless join, in append mode. The table's columns get the prefix b_.

    The table is dealt out in every batch, with a copy for each level of bins that the stream may use; levels: those it does use, if they are
    known (intervals.levels_in_use of a sample won't do). An interval of another level raises an error.
    """
    if levels is None:
        return overlap_join(stream, static, width, list(range(LEVELS)))
    known = F.assert_true(level_of(width).isin(levels), F.lit(f"an interval is of none of the levels {levels}"))
    return overlap_join(stream.where(F.when(F.col("end_pos") > F.col("start_pos"), known).isNull()), static, width, levels)


def sequences(stream: DataFrame, tiles: DataFrame, id_col: str, width: int, reach: int) -> DataFrame:
    """A stream's intervals with their sequences, from tiles that reach into the next ones: a stateless join."""
    return get_sequences(stream, tiles, id_col, width, reach=reach)


def first_rows(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row to arrive of each key, in append mode; a key is forgotten when the watermark has passed its row."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def islands(stream: DataFrame, overlap: int, by: list[str], late: int) -> DataFrame:
    """by.., island (its first start), reach (its largest end), n: islands of intervals that arrive along the genome, in append mode.

    A second of event time is a letter, so that an island is a session whose gap is each interval's own length, less
    `overlap`. An island is given out, and its state dropped, once starts have moved `late` letters past it; intervals that come
    later than that are left out. All groups move along together, as when files are sorted by start. A new island begins where
    (largest end so far) - overlap <= start, as in the table's operator; intervals of one start are of one island.
    """
    # Each task merges its own rows first, so that what is dealt out and sorted by group are islands of tasks.
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    own = F.greatest(F.col("end_pos") - F.col("start_pos") - overlap, F.lit(0))
    # A microsecond short, so that sessions that only touch stay apart; at least one, as a session must last.
    gap = F.when(own > 0, F.concat((own * 1_000_000 - 1).cast("string"), F.lit(" microseconds"))).otherwise(F.lit("1 microsecond"))
    d = stream.withColumns({"_time": F.timestamp_seconds("start_pos"), "_gap": gap}).withWatermark("_time", f"{late} seconds")
    g = d.groupBy(F.session_window("_time", F.col("_gap")).alias("_w"), *by).agg(F.min("start_pos").alias("island"), F.max("end_pos").alias("reach"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, "island", "reach", "n")
