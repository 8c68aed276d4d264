"""Sequences by interval from a genome held in tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.functions.seq import reverse_complement
from sequor.operators.rank import running_total

TILE = 1 << 16


def tile(genome: DataFrame, width: int = TILE, reach: int = 0) -> DataFrame:
    """(chrom, seq) -> (chrom, tile, part): tiles of `width` letters, and the first `reach` of the next one.

    One pass cuts all parts; taking substrings would look for each tile's start from the beginning.
    """
    if reach > width:
        raise ValueError("a tile reaches into the next one only")
    d = genome.select("chrom", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0)).alias("_p"))
    more = lambda p, i: F.concat(p, F.substr(F.coalesce(F.get("_p", i + 1), F.lit("")), F.lit(1), F.lit(reach)))
    return d.select("chrom", F.posexplode(F.transform("_p", more) if reach else F.col("_p")).alias("tile", "part"))


def tile_pieces(pieces: DataFrame, order: str, width: int = TILE, reach: int = 0) -> DataFrame:
    """(chrom, tile, part) as tile gives them, of chromosomes that are many pieces: (chrom, order, seq), one after another along order.

    Pieces find their places by a running total of lengths, and each tile is put together from the pieces in it; no row or task holds
    a chromosome. order tells the pieces of a chromosome apart. A piece is cut where tiles end, so it should not be much longer than one.
    """
    d = running_total(pieces.select("chrom", order, "seq", F.length("seq").cast("long").alias("_n")).where("_n > 0"), ["chrom"], [order], "_n", "_at")
    first, last = F.greatest(F.lit(0), F.floor((F.col("_at") - reach) / width)), F.floor((F.col("_at") + F.col("_n") - 1) / width)
    d = d.withColumn("tile", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("_at"), F.col("tile") * width), F.least(F.col("_at") + F.col("_n"), (F.col("tile") + 1) * width + reach)
    d = d.where(low < high).select("chrom", F.col("tile").cast("int").alias("tile"), low.alias("_low"), F.substr("seq", (low - F.col("_at") + 1).cast("int"), (high - low).cast("int")).alias("_piece"))
    g = d.groupBy("chrom", "tile").agg(F.array_sort(F.collect_list(F.struct("_low", "_piece"))).alias("_p"))
    return g.select("chrom", "tile", F.array_join(F.transform("_p", lambda x: x["_piece"]), "").alias("part"))


def get_sequences(df: DataFrame, tiles: DataFrame, id_col: str, width: int = TILE, strand: bool = True, reach: int = 0) -> DataFrame:
    """Add seq, the genome's letters of each interval, reverse-complemented on strand '-'.

    Intervals that leave their chromosome, or are empty, are dropped. With tiles that reach into the next one by `reach`,
    an interval of up to reach + 1 letters lies in the tile of its start: one equi-join; longer ones raise an
    error (letters are ASCII here, so that a tile's bytes tell its length). Without, each interval meets the tiles it touches and their parts are put together by tile.
    """
    if reach:
        size = F.col("end_pos") - F.col("start_pos")
        ok = F.assert_true(size <= reach + 1, F.lit(f"an interval is longer than {reach + 1}"))
        d = df.where("start_pos >= 0 and end_pos > start_pos").where(ok.isNull()).withColumn("tile", F.floor(F.col("start_pos") / width).cast("int"))
        at = F.col("start_pos") - F.col("tile") * F.lit(width)
        # Bytes are cut without a walk from the tile's beginning, and a tile is turned round once, not each of its intervals.
        sides = {"part": F.col("part").cast("binary")} | ({"_back": reverse_complement(F.col("part")).cast("binary")} if strand else {})
        d = d.join(tiles.withColumns(sides), ["chrom", "tile"]).where(at + size <= F.octet_length("part"))
        cut = lambda side, first: F.substr(side, (first + 1).cast("int"), size.cast("int")).cast("string")
        seq = cut("part", at)
        if strand:
            seq = F.when(F.col("strand") == "-", cut("_back", F.octet_length("part") - at - size)).otherwise(seq)
        return d.select(*df.columns, seq.alias("seq"))
    first, last = F.floor(F.col("start_pos") / width).cast("int"), F.floor((F.col("end_pos") - 1) / width).cast("int")
    d = df.where("start_pos >= 0 and end_pos > start_pos").withColumn("tile", F.explode(F.sequence(first, last)))
    d = d.join(tiles, ["chrom", "tile"])
    low = F.greatest(F.col("start_pos"), F.col("tile") * F.lit(width)) - F.col("tile") * F.lit(width)
    high = F.least(F.col("end_pos"), (F.col("tile") + 1) * F.lit(width)) - F.col("tile") * F.lit(width)
    d = d.withColumn("_piece", F.substr("part", (low + 1).cast("int"), (high - low).cast("int")))
    keys = [c for c in df.columns]
    g = d.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "_piece"))), lambda s: s["_piece"]), "").alias("seq"))
    g = g.where(F.length("seq") == F.col("end_pos") - F.col("start_pos"))
    return _on_strand(g) if strand else g


def _on_strand(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
