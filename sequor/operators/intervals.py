"""Interval operators on (chrom, start_pos, end_pos): half-open, counted from 0."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequor.operators.rank import ranked, running_total
from sequor.session import shared_folder

#: Width of the bins by which overlaps are joined; about the length of common intervals.
BIN = 1024
#: Each level of bins is so many times as wide as the one before; five levels reach over 10^9 letters.
FAN, LEVELS = 32, 5
#: Rows of one island that a task merges at once.
BLOCK = 1 << 15
#: Width of the stretches in which sorted passes run before their results are carried on.
STRETCH = 1 << 16


def max_length(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Intervals shorter than limit."""
    return df.where(F.col("end_pos") - F.col("start_pos") < limit)


def resize(df: DataFrame, width: int) -> DataFrame:
    """Intervals of `width` about the midpoint, halves rounded to even; starts may be negative."""
    if width <= 0:
        raise ValueError("width must be positive")
    left = round(width / 2)
    mid = F.bround((F.col("start_pos") + F.col("end_pos")) / 2).cast("long")
    return df.withColumns({"start_pos": mid - left, "end_pos": mid + (width - left)})


def midpoint() -> Column:
    """The midpoint, truncated."""
    return ((F.col("start_pos") + F.col("end_pos")) / 2).cast("long")


def to_points(df: DataFrame) -> DataFrame:
    return df.withColumn("_mid", midpoint()).withColumns({"start_pos": F.col("_mid"), "end_pos": F.col("_mid") + 1}).drop("_mid")


def extend(df: DataFrame, length: int, sizes: DataFrame | None = None) -> DataFrame:
    """Intervals of `length` about the midpoint, moved up to start at 0 and down to end in the chromosome.

    sizes: (chrom, length), one row a chromosome; a chromosome shorter than `length` gives a negative
    start. Halves of odd lengths are kept until the end and truncated towards zero.
    """
    start = F.greatest(F.lit(0.0), midpoint() - F.lit(length / 2))
    d = df.withColumn("_s", start)
    if sizes is not None:
        d = d.join(F.broadcast(sizes.select("chrom", F.col("length").alias("_len"))), "chrom", "left")
        d = d.withColumn("_s", F.when(F.col("_s") + length > F.col("_len"), F.col("_len") - F.lit(float(length))).otherwise(F.col("_s")))
    d = d.withColumns({"end_pos": (F.col("_s") + length).cast("long"), "start_pos": F.col("_s").cast("long")})
    return d.select(*df.columns)


def normal_strand(strand: Column) -> Column:
    return F.when(strand.isin("+", "-"), strand).otherwise(F.lit("+"))


def keep_chromosomes(df: DataFrame, ignore_y: bool = False, ignore_auxiliary: bool = False) -> DataFrame:
    """Without chrY; or only chr1, chr2, ... and chrX."""
    if ignore_auxiliary:
        df = df.where(F.col("chrom").rlike("^chr[0-9]+$") | (F.col("chrom") == "chrX"))
    return df.where(F.col("chrom") != "chrY") if ignore_y else df


def region_key() -> Column:
    return F.format_string("%s:%d-%d(%s)", "chrom", "start_pos", "end_pos", "strand")


def parse_activity(text: Column) -> Column:
    """'1,3,' -> [1, 3]; '.' -> []."""
    return F.when(text == ".", F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.cast("int")))


def level_of(width: int) -> Column:
    """The bin level of an interval: the first one whose bins are as wide as it is long."""
    n = F.col("end_pos") - F.col("start_pos")
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(n <= width * FAN**k, F.lit(k)).otherwise(level)
    return level


def levels_in_use(df: DataFrame, width: int) -> list[int]:
    """The levels in use, LEVELS numbers at most."""
    return sorted(r[0] for r in df.where("end_pos > start_pos").select(level_of(width).alias("l")).distinct().collect())


def _place(kind: int, place: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), place.alias("bin"))


def _binned(df: DataFrame, width: int, roles: list[tuple[int, str, int]]) -> DataFrame:
    """A row for each bin that the interval touches on its level or, of wider bins, on others.

    roles: (role, comparison of a level with the interval's own, level).
    """
    parts = []
    for role, compare, k in roles:
        w = width * FAN**k
        bins = F.sequence(F.floor(F.col("start_pos") / w), F.floor((F.col("end_pos") - 1) / w))
        rows = F.transform(bins, functools.partial(_place, 2 * k + role))
        parts.append(F.when(F.expr(f"{k} {compare} _level"), rows).otherwise(F.array().cast("array<struct<kind:int,bin:bigint>>")))
    d = df.where("end_pos > start_pos").withColumn("_level", level_of(width))
    return d.withColumn("_at", F.explode(F.concat(*parts))).withColumns({"_kind": F.col("_at.kind"), "_bin": F.col("_at.bin")}).drop("_at", "_level")


def overlap_join(a: DataFrame, b: DataFrame, width: int = BIN, levels: list[int] | None = None) -> DataFrame:
    """Every pair of overlapping intervals of a chromosome; b's columns get the prefix b_.

    Bins have levels, each FAN times as wide as the one before, and an interval lies in the one or two bins of the first level that is as
    wide as it is long. A pair meets on the level of the longer one: each side probes the wider levels that
    the other has intervals on, so an interval of any length has at most two rows a level. A pair that shares two bins is
    kept in the first one, so no distinct is needed. Empty intervals overlap nothing. Both sides are read once more
    beforehand (two columns) for the levels in use; levels, if given, are a's, which may then be a stream.
    """
    of_a, of_b = levels_in_use(a, width) if levels is None else levels, levels_in_use(b, width)
    if not of_a or not of_b:
        of_a = of_b = [0]
    # Kind 0 of a level: a's own intervals with b's shorter or equal ones. Kind 1: b's own with a's shorter ones, if there are any.
    on_b, on_a = [k for k in of_b if k > min(of_a)], [k for k in of_a if k >= min(of_b)]
    left = _binned(a, width, [(0, "=", k) for k in on_a] + [(1, ">", k) for k in on_b])
    right = _binned(b, width, [(0, ">=", k) for k in on_a] + [(1, "=", k) for k in on_b])
    right = right.select(*(F.col(c).alias(c if c in ("chrom", "_kind", "_bin") else f"b_{c}") for c in right.columns))
    d = left.join(right, ["chrom", "_kind", "_bin"])
    wide = F.element_at(F.array(*(F.lit(width * FAN**k) for k in range(LEVELS))), F.floor(F.col("_kind") / 2).cast("int") + 1)
    first = F.floor(F.greatest("start_pos", "b_start_pos") / wide)
    ok = (F.col("start_pos") < F.col("b_end_pos")) & (F.col("b_start_pos") < F.col("end_pos")) & (F.col("_bin") == first)
    return d.where(ok).drop("_kind", "_bin")


def intersect(a: DataFrame, b: DataFrame, id_col: str, nonoverlap: bool = False, width: int = BIN) -> DataFrame:
    """a's rows, once per overlap with b; or, with nonoverlap, a's rows that overlap none."""
    sides = b.select("chrom", "start_pos", "end_pos")
    if not nonoverlap:
        return overlap_join(a, sides, width).select(*a.columns)
    hits = overlap_join(a.select("chrom", "start_pos", "end_pos", id_col), sides, width).select(id_col).distinct()
    return a.join(hits, id_col, "left_anti")


def islands(df: DataFrame, overlap: int, by: list[str], order: list[str], stretch: int = STRETCH) -> DataFrame:
    """Add island: the start of the run of intervals that each reach more than `overlap` into those before.

    A new island begins where (largest end so far) - overlap <= start. Instead of one sorted pass a
    chromosome, passes over stretches of it are joined by carrying on each stretch's largest end and
    last island start; only the table of stretches is passed over as a whole.
    """
    d = df.withColumn("_st", F.floor(F.col("start_pos") / stretch))
    inside = Window.partitionBy(*by, "_st").orderBy("start_pos", *order)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    table = Window.partitionBy(*by).orderBy("_st").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(*by, "_st").agg(F.max("end_pos").alias("_m")).select(*by, "_st", F.max("_m").over(table).alias("_carry"))
    d = d.join(ends, [*by, "_st"])
    reach = F.greatest(F.max("end_pos").over(past), F.col("_carry"))
    d = d.withColumn("_reach", reach).withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_reach") - overlap <= F.col("start_pos")), F.col("start_pos")))
    starts = d.groupBy(*by, "_st").agg(F.max("_new").alias("_m")).select(*by, "_st", F.max("_m").over(table).alias("_from"))
    d = d.join(starts, [*by, "_st"])
    # With its peers by start: of equal intervals one begins the island, and a second sort may put another of them first.
    here = F.max("_new").over(Window.partitionBy(*by, "_st").orderBy("start_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("island", F.coalesce(here, F.col("_from"))).drop("_st", "_carry", "_reach", "_new", "_from")


def sort_places(df: DataFrame, by: list[str], order: list[str], out: str = "place") -> DataFrame:
    """Add `out`: the place from 1 of each interval among those of its `by` along order, which should tell them apart."""
    d = running_total(df.withColumn("_one", F.lit(1)), by, order, "_one", out)
    return d.withColumn(out, (F.col(out) + 1).cast("long")).drop("_one")


def union_activity(activity: Column) -> Column:
    """Aggregate: the sorted set of all targets of a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(activity))))


def merge_at_once(df: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """One region a group: the weighted mean midpoint, weight 1 + number of targets, extended to length."""
    mid = ((F.col("start_pos") + F.col("end_pos") - 1) / 2).cast("double")
    w = F.lit(1) + F.size("activity")
    g = df.groupBy(*keys).agg(F.floor(F.lit(0.5) + F.sum(w * mid) / F.sum(w)).cast("long").alias("mid"), union_activity(F.col("activity")).alias("activity"))
    start = F.greatest(F.lit(0), F.col("mid") - length // 2)
    return g.select(*keys, start.cast("long").alias("start_pos"), (start + length).cast("long").alias("end_pos"), "activity")


Region = tuple[float, float, frozenset[int]]


def merged_place(wa: int, ma: int, wb: int, mb: int, length: int, size: float | None) -> tuple[float, float]:
    """Start and end of `length` about the mean of two midpoints by their weights, kept in the chromosome."""
    start = int(0.5 + (wa * ma + wb * mb) / (wa + wb)) - length / 2
    if start < 0:
        start = 0.0
    end = start + length
    return (start, end) if size is None or end <= size else (size - length, size)


def merge_two(a: Region, b: Region, length: int, size: float | None) -> Region:
    """The region of `length` about the mean of both midpoints, weighted by 1 + number of targets, kept in the chromosome."""
    return *merged_place(1 + len(a[2]), int((a[0] + a[1]) / 2), 1 + len(b[2]), int((b[0] + b[1]) / 2), length, size), a[2] | b[2]


def greedy_merge_block(peaks: list[Region], length: int, overlap: float, size: float | None, before: tuple[float, float] | None = None, after: tuple[float, float] | None = None) -> tuple[list[tuple[int, Region]], bool]:
    """Merge the neighbours that overlap most, the first on ties, while they overlap by at least `overlap`.

    The merged region takes the left one's place in a linked list; a heap holds the overlaps, and those of
    regions that have changed since are passed over.

    The peaks may be a block of an island. before: the largest end and midpoint of the regions in front of it, after: the smallest
    start and midpoint of those behind it, None if there are none. Midpoints of merged regions lie between those of their parts, so
    these bound how far anything from outside, merged or not, can ever reach into the block. A merge is done only if
    no such region could come first in the whole island's order; else the outermost region is given up to the outside and
    bounds the rest. A merge that would make a region overlap with its neighbour, or at the border with anything from outside, by more than was
    merged for would leave a pair that comes too early for the regions outside, and ends the block's turn; that is rare with regions
    of one length, as merged ones lie between their parts, and common with others.
    Returns (place, region) of what is left, and whether anything may be left to merge.
    """
    n = len(peaks)
    start, end, found = [x[0] for x in peaks], [x[1] for x in peaks], [x[2] for x in peaks]
    middle = [int((s + e) / 2) for s, e in zip(start, end, strict=True)]
    left, right, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    turn = [0] * n  # of the pair of each region and its right neighbour: counts its changes, -1 when the region is gone
    heap = [(b - a, k, 0) for k, (a, b) in enumerate(zip(end, start[1:], strict=False)) if a - b >= overlap]
    heapq.heapify(heap)
    low, high = 0, n - 1  # regions in front of low and behind high belong to the outside
    reach = back = None  # the largest end of anything in front of low, the smallest start of anything behind high

    def forward(end: float, mid: float) -> float:
        return max(end, mid + length / 2, length)

    def backward(start: float, mid: float) -> float:
        return min(start, mid - length / 2, start if size is None else size - length - 1)

    if before:
        reach = forward(*before)
    if after:
        back = backward(*after)
    outside, pending, lowest = bool(before or after), False, math.inf
    while heap:
        o, k, v = heap[0]
        if turn[k] != v:
            heapq.heappop(heap)
            continue
        j = right[k]
        if k < low or j > high:
            pending = True
            heapq.heappop(heap)
        elif reach is not None and -o <= reach - start[low]:
            reach = max(reach, forward(end[low], middle[low]))
            low, pending = right[low], True
        elif back is not None and -o < end[high] - back:
            back = min(back, backward(start[high], middle[high]))
            high, pending = left[high], True
        else:
            s, e = merged_place(1 + len(found[k]), middle[k], 1 + len(found[j]), middle[j], length, size)
            lowest = min(lowest, -o)
            p, r = left[k], right[j]
            past, next_ = reach if k == low else end[p], back if j == high else start[r]
            if outside and ((past is not None and past - s > lowest) or (next_ is not None and e - next_ > lowest)):
                pending = True
                break
            heapq.heappop(heap)
            start[k], end[k], middle[k], found[k] = s, e, int((s + e) / 2), found[k] | found[j]
            live[j], turn[j] = False, -1
            right[k] = r
            turn[k] += 1
            if r < n:
                left[r] = k
                if e - start[r] >= overlap:
                    heapq.heappush(heap, (start[r] - e, k, turn[k]))
            if j == high:
                high = k
            if p >= 0:
                turn[p] += 1
                if end[p] - s >= overlap:
                    heapq.heappush(heap, (s - end[p], p, turn[p]))
    rest = [(k, (start[k], end[k], found[k])) for k in range(n) if live[k]]
    if rest and reach is not None:
        pending |= low >= n or reach - start[low] >= overlap
    if rest and back is not None:
        pending |= high < 0 or end[high] - back >= overlap
    return rest, pending


def greedy_merge_island(peaks: list[Region], length: int, overlap: float, size: float | None) -> list[Region]:
    """A whole island of greedy_merge_block."""
    return [x for _, x in greedy_merge_block(peaks, length, overlap, size)[0]]


def target_sets(activity: Iterable[np.ndarray]) -> list[frozenset[int]]:
    """The sets of rows' targets, one object for equal rows."""
    known: dict[bytes, frozenset[int]] = {}
    out = []
    for a in activity:
        key = a.tobytes()
        if key not in known:
            known[key] = frozenset(a.tolist())
        out.append(known[key])
    return out


def greedy_merge(df: DataFrame, length: int, overlap: int, by: list[str], sizes: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Regions (by.., start_pos, end_pos, activity) merged within islands, in the order that greedy_merge_block states.

    Islands of up to `block` regions go whole to a Python function, many in a batch; single intervals pass by. Larger
    ones are merged in rounds of blocks (merge_large_islands). sizes: (chrom, length), a row a chromosome. Starts are 0 or more.
    """
    shared_folder(df.sparkSession)
    d = df.withColumn("length", F.lit(None).cast("long")) if sizes is None else df.join(sizes.select("chrom", F.col("length").cast("long").alias("length")), "chrom", "left")
    d = islands(d.select(*by, "start_pos", "end_pos", F.array_sort("activity").alias("activity"), "length"), overlap, by, ["end_pos"]).checkpoint()
    keys = [*by, "island"]
    schema = d.select(*by, "start_pos", "end_pos", "activity").schema
    large = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(*keys).checkpoint()
    none = large.isEmpty()
    large = F.broadcast(large)  # an island for each `block` rows at most, and so are the tables of blocks and of islands below
    small = d if none else d.join(large, keys, "left_anti")
    grouped = small.groupBy(*keys).agg(F.max("length").alias("_len"), F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "activity"))).alias("_peaks"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            rows = []
            for head, size, found in zip(p[by].itertuples(index=False, name=None), p["_len"], p["_peaks"], strict=True):
                peaks = [(float(x["start_pos"]), float(x["end_pos"]), frozenset(x["activity"])) for x in found]
                rows += [(*head, int(s), int(e), sorted(a)) for s, e, a in greedy_merge_island(peaks, length, overlap, None if pd.isna(size) else float(size))]
            yield pd.DataFrame(rows, columns=schema.names)

    one = grouped.where("size(_peaks) = 1").select(*by, F.col("_peaks")[0]["start_pos"].alias("start_pos"), F.col("_peaks")[0]["end_pos"].alias("end_pos"), F.col("_peaks")[0]["activity"].alias("activity"))
    out = one.unionByName(grouped.where("size(_peaks) > 1").select(*by, "_len", "_peaks").mapInPandas(merge, schema))
    return out if none else out.unionByName(merge_large_islands(d.join(large, keys, "left_semi"), length, overlap, keys, block).select(*schema.names))


def merge_large_islands(d: DataFrame, length: int, overlap: int, keys: list[str], block: int) -> DataFrame:
    """The greedy merge of islands (keys) that no task should hold: d(keys.., start_pos, end_pos, activity, length).

    A round numbers the regions along the genome, cuts them into blocks of `block` and merges each block as far as nothing outside it can
    interfere; for that, the ends and midpoints before and behind a block come from a table with a row for each island and block.
    Islands in which nothing is left to merge leave; for the others the next round's blocks are cut
    half a block further. Regions shrink with every merge, and an island that fits into a block is done. If a round
    merges nothing, the largest overlap of each island is merged, which is always right.
    """
    names = [*keys, "start_pos", "end_pos", "activity", "length"]
    doubles = {"start_pos": F.col("start_pos").cast("double"), "end_pos": F.col("end_pos").cast("double")}
    rest = ranked(d.select(*names).withColumns(doubles), [*keys, "start_pos", "end_pos", "activity"], "place")
    done: list[DataFrame] = []
    many, shift, idle = rest.count(), 0, 0
    while many:
        rest = rest.withColumn("_block", F.floor((F.col("place") + (shift * (block // 2))) / block)).checkpoint()
        mid = F.floor((F.col("start_pos") + F.col("end_pos")) / 2)
        table = rest.groupBy(*keys, "_block").agg(F.max("end_pos").alias("_e"), F.max(mid).alias("_m"), F.min("start_pos").alias("_s"), F.min(mid).alias("_l"))
        w = Window.partitionBy(*keys).orderBy("_block")
        past, next_ = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        table = table.select(*keys, "_block", F.max("_e").over(past).alias("_be"), F.max("_m").over(past).alias("_bm"), F.min("_s").over(next_).alias("_as"), F.min("_l").over(next_).alias("_am"))
        joined = rest.join(F.broadcast(table), [*keys, "_block"])
        schema = joined.select(*names, "place").withColumn("_open", F.lit(True)).schema

        def merge(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("place", kind="stable")
            rows = []
            for head, g in p.groupby(keys, sort=False):
                peaks = list(zip(g["start_pos"].tolist(), g["end_pos"].tolist(), target_sets(g["activity"]), strict=True))
                f = g.iloc[0]
                size = None if pd.isna(f["length"]) else float(f["length"])
                before = None if pd.isna(f["_be"]) else (float(f["_be"]), float(f["_bm"]))
                after = None if pd.isna(f["_as"]) else (float(f["_as"]), float(f["_am"]))
                kept, pending = greedy_merge_block(peaks, length, overlap, size, before, after)
                rows += [(*head, s, e, sorted(a), f["length"], g["place"].iat[k], pending) for k, (s, e, a) in kept]
            got = pd.DataFrame(rows, columns=schema.names)
            return got.astype({"length": "Int64"})

        merged = joined.groupBy("_block").applyInPandas(merge, schema).checkpoint()
        now = merged.count()
        pending = F.broadcast(merged.where("_open").select(*keys).distinct().checkpoint())
        done.append(merged.join(pending, keys, "left_anti").select(*names))
        rest = ranked(merged.join(pending, keys, "left_semi").drop("_open"), ["place"], "_next").withColumn("place", F.col("_next")).drop("_next").checkpoint()
        idle = idle + 1 if now == many else 0
        many, shift = rest.count(), 1 - shift
        if idle > 1 and many:
            closest = _closest(rest, keys, overlap)
            done.append(rest.join(closest.select(*keys), keys, "left_anti").select(*names))
            rest = _merge_closest(rest.join(closest.select(*keys), keys, "left_semi"), closest, length, keys).checkpoint()
            many, idle = rest.count(), 0
    out = done[0].unionByName(d.select(*names).where("false")) if done else d.select(*names)
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumns({"start_pos": F.col("start_pos").cast("long"), "end_pos": F.col("end_pos").cast("long")})


def _closest(rest: DataFrame, keys: list[str], overlap: int) -> DataFrame:
    """keys.., at: the place of the first of each island's pairs of neighbours with the largest overlap, if that is at least `overlap`."""
    after = rest.select(*keys, (F.col("place") - 1).alias("place"), F.col("start_pos").alias("_s"))
    beyond = F.col("end_pos") - F.col("_s")
    return rest.join(after, [*keys, "place"]).where(beyond >= overlap).groupBy(*keys).agg((-F.max(F.struct(beyond, -F.col("place")))["col2"]).alias("at")).checkpoint()


def _merge_closest(rest: DataFrame, closest: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """rest with the regions at `at` and behind it merged in each island."""
    d, names = rest.join(closest, keys), rest.columns
    pair = d.where("place between at and at + 1").groupBy(*keys, "at", "length").agg(F.array_sort(F.collect_list(F.struct("place", "start_pos", "end_pos", "activity"))).alias("p"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for (a, b), size in zip(f["p"], f["length"], strict=True):
                s, e, act = merge_two(*((x["start_pos"], x["end_pos"], frozenset(x["activity"])) for x in (a, b)), length, None if pd.isna(size) else float(size))
                got.append((s, e, sorted(act)))
            yield f.drop(columns="p").assign(start_pos=[x[0] for x in got], end_pos=[x[1] for x in got], activity=[x[2] for x in got], place=f["at"]).astype({"length": "Int64"})[names]

    return d.where("place not between at and at + 1").select(*rest.columns).unionByName(pair.mapInPandas(merge, rest.schema))


def activity_row(n_targets: int, activity: Column) -> Column:
    """'0\\t1\\t...': one flag a target."""
    if n_targets <= 0:
        return F.lit("")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_targets - 1)), lambda i: F.array_contains(activity, i).cast("int").cast("string")), "\t")
