"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.llm.common import cut, gapless_rank, join_counted, prepare
from sequor.operators.rank import ranked

#: Neighbouring places of groups whose runs are looked up together.
CHUNK = 64

#: (which size, how many of its items, their bin); runs of one size are in the order of its items.
Run = tuple[int, int, int]


class RoomTree:
    """The bins' remaining capacities in order: a balanced tree of two levels whose leaves split in half."""

    LEAF = 512

    def __init__(self, rooms: list[tuple[int, int]]):
        rooms = sorted(rooms)
        self.leaves = [rooms[k : k + self.LEAF // 2] for k in range(0, len(rooms), self.LEAF // 2)]
        self.tops = [x[-1] for x in self.leaves]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, bin) with room for size; ties go to the lowest bin."""
        k = bisect_left(self.tops, (size, -1))
        if k == len(self.tops):
            return None
        leaf = self.leaves[k]
        out = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[k] = leaf[-1]
        else:
            del self.leaves[k], self.tops[k]
        return out

    def put(self, room: int, b: int) -> None:
        k = min(bisect_left(self.tops, (room, b)), len(self.tops) - 1)
        if k < 0:
            self.leaves.append([(room, b)])
            self.tops.append((room, b))
            return
        leaf = self.leaves[k]
        insort(leaf, (room, b))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.tops[k : k + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.tops[k] = leaf[-1]


def best_fit_runs(sizes: Sequence[int], counts: Sequence[int], bins: int, capacity: int) -> list[Run] | None:
    """Best-fit decreasing of counts[k] items of sizes[k] (decreasing), or None if they don't fit.

    Each item enters the bin with the least room that holds it; ties go to the lowest bin. A bin that took
    an item stays the tightest as long as it holds one more of that size, so it takes a run of them at
    once. A run ends its size or leaves its bin with less than half of its room, so there are at most
    len(sizes) + bins * log2(capacity) runs, however many items there are.
    """
    tree = RoomTree([(capacity, b) for b in range(bins)])
    out = []
    for k, (size, left) in enumerate(zip(sizes, counts, strict=True)):
        while left:
            found = tree.take(size)
            if found is None:
                return None
            n = min(left, found[0] // size)
            tree.put(found[0] - n * size, found[1])
            out.append((k, n, found[1]))
            left -= n
    return out


def fewest_bins_runs(sizes: Sequence[int], counts: Sequence[int], capacity: int) -> list[Run]:
    """Best-fit decreasing into bins of one capacity, opened as needed; a larger item gets one of its own."""
    tree = RoomTree([])
    out, bins = [], 0
    for k, (size, left) in enumerate(zip(sizes, counts, strict=True)):
        while left:
            found = tree.take(size) if size <= capacity else None
            room, b = found or (capacity, bins)
            bins += found is None
            n = min(left, max(1, room // size))
            if size <= capacity:
                tree.put(room - n * size, b)
            out.append((k, n, b))
            left -= n
    return out


def least_capacity_runs(sizes: Sequence[int], counts: Sequence[int], bins: int) -> list[Run]:
    """Best-fit decreasing at the smallest capacity for which the items fit into the bins."""
    if not sizes:
        return []
    low = max(sizes[0], -(-sum(x * n for x, n in zip(sizes, counts, strict=True)) // bins))
    high = low + sizes[0]
    best = best_fit_runs(sizes, counts, bins, high)
    while best is None:
        high *= 2
        best = best_fit_runs(sizes, counts, bins, high)
    while low < high:
        mid = (low + high) // 2
        found = best_fit_runs(sizes, counts, bins, mid)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid
    return best


def by_item(runs: list[Run] | None) -> list[int] | None:
    return None if runs is None else [b for _, n, b in runs for _ in range(n)]


def best_fit(sizes: list[int], bins: int, capacity: int) -> list[int] | None:
    """The bin of each item (given in decreasing size), or None if they don't fit."""
    return by_item(best_fit_runs(sizes, [1] * len(sizes), bins, capacity))


def fewest_bins(sizes: list[int], capacity: int) -> list[int]:
    return by_item(fewest_bins_runs(sizes, [1] * len(sizes), capacity))


def least_capacity(sizes: list[int], bins: int) -> list[int]:
    return by_item(least_capacity_runs(sizes, [1] * len(sizes), bins))


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size, text_crc32 and _key, the digest of the text; materialised."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("_key"),
        )
    )


def pack(rows: DataFrame, plan: Callable[[Sequence[int], Sequence[int]], list[Run]]) -> DataFrame:
    """doc_id, size, text_crc32, shard: groups of equal _key placed by plan(decreasing sizes, groups of each).

    The driver packs every group, but sees only the different sizes: n of them need n * (n + 1) / 2 bytes
    of text, so 100 TB have 14 million at most, and a million if no group has over a megabyte. Groups of one size
    are interchangeable; they take its runs in the order of their keys.
    """
    spark = rows.sparkSession
    groups = cut(rows.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    found = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("bytes", "descending")])
    sizes, counts = found["bytes"].to_pylist(), found["n"].to_pylist()
    runs = plan(sizes, counts)
    whole = [(sizes[k], b) for k, n, b in runs if n == counts[k]]
    firsts, parts, at, last = [], [], 0, None
    for k, n, b in runs:
        if n < counts[k]:
            if k != last:
                firsts.append(sizes[k])
            parts.append((at, at + n, b))
            at, last = at + n, k
    of_size = table(spark, whole, {"bytes": pa.int64(), "shard": pa.int32()})
    placed = groups.join(of_size, "bytes").select("_key", "n", "shard")
    if parts:
        places = ranked(groups.join(table(spark, [(x,) for x in firsts], {"bytes": pa.int64()}), "bytes"), [F.desc("bytes"), "_key"], "_at")
        of_part = table(spark, parts, {"_from": pa.int64(), "_to": pa.int64(), "shard": pa.int32()})
        of_part = of_part.withColumn("_chunk", F.explode(F.expr(f"sequence(_from div {CHUNK}, (_to - 1) div {CHUNK})")))
        split = places.withColumn("_chunk", F.expr(f"_at div {CHUNK}")).join(of_part, "_chunk").where("_at >= _from and _at < _to")
        placed = placed.unionByName(split.select("_key", "n", "shard"))
    return join_counted(rows, cut(placed), ["_key"], "n").select("doc_id", "size", "text_crc32", "shard")


def table(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds)))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Place every row into one of `shards` shards of nearly equal bytes (law `bytes`).

    Rows of equal texts are indivisible. Output: the id, size, text_crc32, law, shard, slot.
    Null texts count as empty ones (size 1, checksum 0) and so form one group with them; a group
    larger than a fair share makes its shard larger, since it can't be divided. Repeated ids are
    rows like any other. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    out = pack(sized(docs, id_col, text_col), lambda sizes, counts: least_capacity_runs(sizes, counts, shards))
    out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    return gapless_rank(cut(out), "shard", F.col("doc_id"), [F.col("doc_id"), F.col("text_crc32")], "slot", salts=256)


def shard_by_capacity(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard: as few shards of at most `capacity` bytes as best-fit decreasing needs.

    Rows of equal texts are indivisible; such a group of more than `capacity` bytes gets a shard of its own,
    the only kind that exceeds it. The driver holds the different sizes and some runs per shard, at most
    log2(capacity) and one for each size. Null texts count as empty.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    prepare(docs.sparkSession)
    return pack(sized(docs, id_col, text_col), lambda sizes, counts: fewest_bins_runs(sizes, counts, capacity))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
