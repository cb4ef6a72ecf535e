"""Sharding by a minimax contiguous partition.

Groups of equal texts are atoms: ordered by the digest of their text (a fixed order that neither arrival nor source
influences) they are cut into contiguous shards so that the largest shard is as small as any such cut allows. Its
capacity is found by search: for a capacity, shards are filled greedily, and it is feasible if they hold everything. A
round tries several capacities at once, so that each greedy step is one look-up job over stored prefix sums; once the
cuts of the last infeasible and the first feasible capacity have few groups between them, these are fetched and the
search ends by halving on the driver. Then the cuts are laid: each as near to an equal share of what is left as the
capacity allows, so no shard stands empty while others are full.

Results for odd input: a null text counts as an empty one (size 8, checksum 0); repeated rows each get a slot of their
own; an empty table gives no rows; with fewer groups than shards some shards stay empty; other columns are not read.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import fresh_path, keep

#: Rows of one bucket of the digest order (a window over them is one task's), hex digits of it that one window orders.
BUCKET_ROWS, DIGITS_A_STEP = 50_000, 3


def bucket_offsets(totals: DataFrame, digits: int) -> DataFrame:
    """(bucket, bytes_before, rows_before) of buckets named by hex prefixes, a few digits at a time: no window has over 16 ** DIGITS_A_STEP rows."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    if digits <= DIGITS_A_STEP:
        w = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        return totals.select("bucket", before("bytes", w).alias("bytes_before"), before("n", w).alias("rows_before"))
    parent = F.substring("bucket", 1, digits - DIGITS_A_STEP)
    up = bucket_offsets(totals.groupBy(parent.alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), digits - DIGITS_A_STEP)
    w = W.partitionBy("parent").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    own = totals.withColumn("parent", parent).select("parent", "bucket", before("bytes", w).alias("b"), before("n", w).alias("r"))
    return own.join(up.withColumnRenamed("bucket", "parent"), "parent").select("bucket", (F.col("b") + F.col("bytes_before")).alias("bytes_before"), (F.col("r") + F.col("rows_before")).alias("rows_before"))


class PrefixSums:
    """Look-ups in the stored groups: ends (bytes of all groups up to and with it), in files of contiguous ranges, so that a look-up reads few of them."""

    def __init__(self, groups: DataFrame, total: int, largest: int):
        self.groups, self.total, self.largest = groups, total, largest

    def last_ends(self, limits: list[int]) -> list[int]:
        """For each limit the largest end not above it, 0 if none."""
        limits = [min(x, self.total) for x in limits]
        near = self.groups.filter(F.col("end").between(min(limits) - self.largest, max(limits)))
        return [x or 0 for x in near.agg(*(F.max(F.when(F.col("end") <= x, F.col("end"))) for x in limits)).first()]

    def next_end(self, limit: int) -> int:
        """The smallest end above limit; the total if none."""
        return self.groups.filter((F.col("end") > limit) & (F.col("end") <= limit + self.largest)).agg(F.min("end")).first()[0] or self.total

    def greedy(self, capacities: list[int], shards: int) -> list[list[int]]:
        """For each capacity the ends of its shards, filled greedily."""
        cuts: list[list[int]] = [[] for _ in capacities]
        at = [0] * len(capacities)
        for _ in range(shards):
            if min(at) == self.total:
                at = list(at)
            else:
                at = self.last_ends([a + c for a, c in zip(at, capacities, strict=True)])
            for c, a in zip(cuts, at, strict=True):
                c.append(a)
        return cuts


def smallest_capacity(sums: PrefixSums, shards: int, candidates: int, max_fetch: int) -> int:
    """The least capacity with which greedy filling places all groups in so many shards."""
    lo, hi = max(-(-sums.total // shards), sums.largest) - 1, max(-(-sums.total // shards), 0) + sums.largest
    lo_cuts: list[int] | None = None  # lo is infeasible, hi feasible
    while hi - lo > 1:
        tries = sorted({lo + (hi - lo) * (i + 1) // (candidates + 1) for i in range(candidates)} - {lo, hi}) or [hi - 1]
        cuts = sums.greedy([*tries, hi], shards)
        good = next(i for i, c in enumerate(cuts) if c[-1] == sums.total)
        hi, hi_cuts = [*tries, hi][good], cuts[good]
        if good:
            lo, lo_cuts = tries[good - 1], cuts[good - 1]
        if lo_cuts is None:
            continue
        between = F.lit(False)
        for a, b in zip(lo_cuts, hi_cuts, strict=True):
            between = between | F.col("end").between(a, b)
        some = sums.groups.filter(between).select("end").limit(max_fetch + 1)
        ends = sorted(r[0] for r in some.collect())
        if len(ends) > max_fetch:
            continue

        def fits(capacity: int) -> bool:
            at = 0
            for _ in range(shards):
                k = bisect.bisect_right(ends, at + capacity)
                at = ends[k - 1] if k else 0
            return at == sums.total

        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def even_cuts(sums: PrefixSums, shards: int, capacity: int) -> list[int]:
    """Ends of shards of at most capacity, each as near to an equal share of the rest as that allows."""
    least = [sums.total]  # from the end: how far the shards before must reach
    for _ in range(shards - 1):
        need = least[-1] - capacity
        least.append(0 if need <= 0 else sums.next_end(need - 1))
    least.reverse()
    cuts, at = [], 0
    for k in range(shards - 1):
        share = at + (sums.total - at) // (shards - k)
        below, top = sums.last_ends([share, at + capacity])
        above = sums.next_end(share)
        best = above if below <= at or above - share < share - below else below  # each shard takes a group while there are any
        at = max(at, least[k], min(best, top))
        cuts.append(at)
    return [*cuts, sums.total]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, cell_rows: int = 50_000, candidates: int = 15, max_fetch: int = 100_000) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row: slots of a shard count from 0 without gaps.

    cell_rows: rows of one group that are numbered together, about, however many it has. max_fetch: prefix sums on the driver, at most.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.count()
    # rows without an id are spread by their place, all others by their id
    spread = F.pmod(F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(id_col)), F.lit(max(64, math.ceil(rows / cell_rows)))).cast("int")
    base = keep(docs.select(F.col(id_col), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("grp"), spread.alias("salt")))
    kinds = T.StructType([base.schema[id_col], base.schema["size"], base.schema["text_crc32"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    if not rows:
        return spark.createDataFrame([], kinds)
    digits = max(2, min(12, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16))))
    bucket = F.substring("grp", 1, digits)
    cells = keep(base.groupBy("grp", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    whole = cells.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn("bucket", bucket)
    totals = whole.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    w = W.partitionBy("bucket").orderBy("grp").rowsBetween(W.unboundedPreceding, 0)
    summed = (
        whole.join(bucket_offsets(totals, digits), "bucket")
        .repartitionByRange("bucket")
        .select("grp", "n", "bytes", (F.sum("bytes").over(w) + F.col("bytes_before")).alias("end"), (F.sum("n").over(w) + F.col("rows_before")).alias("end_rows"))
    )
    path = fresh_path(spark, "prefix-sums")
    summed.write.parquet(path)
    groups = spark.read.parquet(path)
    total, largest = groups.agg(F.max("end"), F.max("bytes")).first()
    sums = PrefixSums(groups, total, largest)
    cuts = even_cuts(sums, shards, smallest_capacity(sums, shards, candidates, max_fetch))
    rows_at = dict(groups.filter(F.col("end").isin(cuts)).select("end", "end_rows").collect())

    def of_shard(values: list) -> Column:
        """values[shard]"""
        return F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)

    shard = sum((F.col("end") > c).cast("int") for c in cuts[:-1]) if shards > 1 else F.lit(0)
    first_rows = [0, *(rows_at.get(c, 0) for c in cuts[:-1])]
    placed = cells.join(groups, "grp").select("grp", "salt", shard.alias("shard"), (F.col("end_rows") - groups["n"] + F.coalesce(F.sum(cells["n"]).over(W.partitionBy("grp").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("row"))
    placed = placed.select("grp", "salt", "shard", (F.col("row") - of_shard(first_rows)).alias("at"))
    in_cell = F.row_number().over(W.partitionBy("grp", "salt").orderBy(id_col)) - 1
    return base.withColumn("k", in_cell).join(placed, ["grp", "salt"]).select(id_col, "size", "text_crc32", "shard", (F.col("at") + F.col("k")).cast("long").alias("slot"))
