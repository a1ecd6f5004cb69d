"""Sampled splitters: size-weighted key samples give quantile boundaries, rows are dealt by range, overfull ranges are divided.

The key of a row is (hash of its text, doc_id), so equal texts lie side by side.  The law is ``bytes``: shards hold nearly
the same number of bytes.

1. A row enters the sample with a chance in proportion to its size plus the mean size, so that ranges are bounded in bytes
   and in rows (decided by a hash of its key, so a retried task draws the same rows).  About ``PER_RANGE`` draws fall on each range; the sample is used for boundaries only.
2. Every ``PER_RANGE``-th draw in key order is a splitter.  A splitter falls between two texts, unless the same text fills a
   whole range: such a group of copies is overfull and is divided by doc_id.
3. Rows find their range by binary search among the splitters; each range is summed exactly, so the offset of every row
   among all bytes is exact although the splitters are sampled.
4. Texts larger than a 64th of a shard (at most ``64 * shards`` of them can exist) are dealt first, largest to smallest, to
   and fro over the shards; the others fill what is left of each shard by their offsets.  A group of copies up to that size
   stays in one shard, a larger one is divided.

Only keys and sizes move: texts are never shuffled.  No task sees more than the keys of one range, and the number of ranges
grows with the rows.  What reaches the driver are the splitters (one per range) and one row per shard.

Defined results: a null text has size 1 and the checksum of the empty text; empty texts are a group like any other; rows
that repeat a doc_id are placed each for itself; an empty table gives no rows; other columns are left out of the key and
do not disturb it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.llm.common import stage

SHARDS = 16
ROWS_PER_RANGE = 1_000_000
PER_RANGE = 16
LARGE = 64


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, size, checksum and text hash of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )


def splitters(rows: DataFrame, total: int, n_ranges: int, share: int = 0) -> list[tuple[int, int | None]]:
    """Up to ``n_ranges - 1`` keys, ascending; a null doc_id stands before all rows of that text.

    A row weighs its size and ``share``; ``total`` is the weight of all rows.
    """
    if n_ranges < 2:
        return []
    draws = n_ranges * PER_RANGE
    step = max(1, total // draws)  # one draw for so much weight
    luck = F.pmod(F.xxhash64(F.lit(7), "h", "doc_id"), F.lit(step))
    times = F.floor((F.col("size") + F.lit(share) + luck) / step).cast("int")
    # a row of several steps is drawn several times: the weight is its size and share
    sample = rows.select("h", "doc_id", times.alias("_times")).filter("_times > 0")
    spread = W.orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    upto = sample.withColumn("_upto", F.sum("_times").over(spread))
    chosen = upto.filter(F.floor(F.col("_upto") / PER_RANGE) > F.floor((F.col("_upto") - F.col("_times")) / PER_RANGE))
    keys = sorted((r["h"], r["doc_id"] if r["doc_id"] is not None else -(2**63)) for r in chosen.select("h", "doc_id").distinct().collect())
    times_seen: dict[int, int] = {}
    for h, _ in keys:
        times_seen[h] = times_seen.get(h, 0) + 1
    cut = {(h, d) if times_seen[h] > 1 else (h, None) for h, d in keys} | {(h, None) for h, n in times_seen.items() if n > 1}
    return sorted(cut, key=lambda k: (k[0], k[1] is not None, k[1] or 0))


def range_of(cuts: list[tuple[int, int | None]]) -> Column:
    """Number of splitters at or before the row's key: a binary search over a constant array."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    known = F.from_json(F.lit(json.dumps([{"h": h, "d": d} for h, d in cuts])), "array<struct<h:bigint,d:bigint>>")
    doc = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))

    def move(pos: Column, step: Column) -> Column:
        at = F.get(known, pos + step - 1)
        before = (at["h"] < F.col("h")) | ((at["h"] == F.col("h")) & (at["d"].isNull() | (at["d"] <= doc)))
        return F.when(F.coalesce(before, F.lit(False)), pos + step).otherwise(pos)

    return F.aggregate(F.lit(steps), F.lit(0), move)


def _capacities(spark, per_shard: list[int], total: int) -> list[float]:
    """Upper ends, in offsets of the small rows, of the room that large rows leave in each shard."""
    small = total - sum(per_shard)
    room, open_shards = [0.0] * len(per_shard), set(range(len(per_shard)))
    while open_shards:  # level the shards that are below the mean of those still open
        level = (small + sum(per_shard[s] for s in open_shards)) / len(open_shards)
        over = {s for s in open_shards if per_shard[s] > level}
        if not over:
            for s in open_shards:
                room[s] = level - per_shard[s]
            break
        open_shards -= over
    ends, upto = [], 0.0
    for r in room:
        upto += r
        ends.append(upto)
    return ends


def assign(documents: DataFrame, shards: int = SHARDS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, shard and gapless slot of every row."""
    spark = documents.sparkSession
    rows = stage(keyed(documents), "shard-keys")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    n, total = seen["n"], seen["b"] or 0
    if n == 0:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    limit = max(1, total // (shards * LARGE))
    mean = -(-total // n)
    # bytes and rows weigh alike, so twice the ranges keep each below the bytes and about the rows of one range
    cuts = splitters(rows, total + n * mean, 2 * max(shards * 8, n // rows_per_range), mean)
    ranged = rows.withColumn("_r", range_of(cuts)).withColumn("_large", F.col("size") > limit)
    # large rows: at most shards * LARGE of them by their size
    order = F.row_number().over(W.orderBy(F.desc("size"), "h", "doc_id")) - 1
    turn = F.pmod(F.col("_k"), F.lit(2 * shards))
    dealt = ranged.filter("_large").withColumn("_k", order).withColumn("shard", F.when(turn < shards, turn).otherwise(2 * shards - 1 - turn).cast("int"))
    dealt = stage(dealt.withColumn("slot", F.row_number().over(W.partitionBy("shard").orderBy("_k")).cast("long") - 1), "shard-large")
    held = {r["shard"]: (r["n"], r["b"]) for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()}
    ends = _capacities(spark, [held.get(s, (0, 0))[1] for s in range(shards)], total)
    small = ranged.filter(~F.col("_large"))
    sums = small.groupBy("_r").agg(F.sum("size").alias("_b"))
    before = sums.select("_r", (F.sum("_b").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, 0)) - F.col("_b")).alias("_before"))
    inside = W.partitionBy("_r").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    group = W.partitionBy("_r", "h")
    placed = small.withColumn("_upto", F.sum("size").over(inside)).withColumn("_group", F.sum("size").over(group)).withColumn("_end", F.max("_upto").over(group))
    # the middle of what stays together decides: the whole group up to the limit, else the single row
    whole = F.col("_group") <= limit
    middle = F.col("_before") + F.when(whole, F.col("_end") - F.col("_group") / 2).otherwise(F.col("_upto") - F.col("size") / 2)
    # a group divided over ranges starts its first one; where its many rows are few bytes it has one middle, too
    divided = sorted({h for h, d in cuts if d is not None})
    groups = small.filter(F.col("h").isin(divided)).groupBy("h").agg(F.sum("size").alias("_whole"), F.min("_r").alias("_r"))
    groups = groups.join(before, "_r").select("h", "_whole", (F.col("_before") + F.col("_whole") / 2).alias("_common"))
    apart = placed.join(before, "_r").join(F.broadcast(groups), "h", "left")
    placed = apart.withColumn("_m", F.when(F.col("_whole").isNull(), middle).when(F.col("_whole") <= limit, F.col("_common")).otherwise(F.col("_before") + F.col("_upto") - F.col("size") / 2))
    shard = F.lit(0)
    for s in range(shards - 1):
        shard = shard + F.when(F.col("_m") >= ends[s], 1).otherwise(0)
    placed = placed.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", "h", "_r", "shard")
    counts = placed.groupBy("shard", "_r").agg(F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, held.get(s, (0, 0))[0])])
    bases = counts.select("shard", "_r", (first + F.element_at(starts, F.col("shard"))).alias("_base"))
    rank = F.row_number().over(W.partitionBy("_r", "shard").orderBy("h", "doc_id"))
    numbered = placed.withColumn("_rank", rank).join(bases, ["shard", "_r"])
    rest = numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_rank") - 1).cast("long").alias("slot"))
    return rest.unionByName(dealt.select("doc_id", "size", "text_crc32", "shard", "slot"))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The whole rows as one folder per shard, in slot order inside a file (doc_id must be unique)."""
    placed = assign(documents, shards).select("doc_id", "shard", "slot")
    joined = documents.drop("shard", "slot").join(placed, "doc_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(documents: DataFrame) -> DataFrame:
    """The columns of op5."""
    return assign(documents.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
