"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions alone.

Every (key, shard) pair draws a number u in (0, 1) from their md5; the shard with the greatest weight / -ln(u)
takes the record. A new shard only ever wins records for itself, so nothing moves between old shards, and a
change of one weight moves records only to or from that shard.

Slots number a shard's records in the order of an md5 of key and checksum. That order starts with the md5's first
digits, so counts by prefix, summed up, give each prefix its first slot, and records are ordered within a prefix
only: no task orders a whole shard. Wholly equal records are counted before they are shuffled and spread out again
after, so they do not crowd a prefix either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
RECORD_OVERHEAD = 8
PREFIX_DIGITS = 3
RUN = 65_536


def draw(key: Column, shard: Column | int) -> Column:
    """A number in (0, 1), fixed by key and shard: the first 13 hex digits of their md5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), F.lit(shard).cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**52


def _cost(key: Column, shard: int, weight: float) -> Column:
    """What a shard bids for a key: the least cost takes it."""
    return -F.log(draw(key, shard)) / float(weight)


def cheapest(key: Column, weights: Sequence[float]) -> Column:
    """Struct of cost and shard of the shard that takes a key; shard i has weight weights[i]. Equal costs go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    costs = [F.struct(_cost(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.least(*costs) if len(costs) > 1 else costs[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; shard i has weight weights[i]. Equal scores go to the lower shard."""
    return cheapest(key, weights).getField("shard")


def shard(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weights: Sequence[float] | None = None, prefix_digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot and grown_shard of every row.

    size is the text's UTF-8 bytes (none for null) plus 8; text_crc32 is 0 for a null or empty text. Rows with
    a null id count as one key, the empty string. Repeated ids share a shard and have slots of their own, wholly
    equal rows successive ones. No rows give none. Texts of any length take part whole. Other columns are not
    carried.
    """
    grown = tuple(weights) + (1.0,) if grown_weights is None else tuple(grown_weights)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    sized = documents.select(F.col(id_col), (F.length(raw) + RECORD_OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    drawn = sized.withColumn("_best", cheapest(key, weights))  # in the scan's tasks, once
    if grown[:-1] == tuple(weights):  # only the new shard's draw is new
        moved = F.when(_cost(key, len(weights), grown[-1]) < F.col("_best.cost"), len(weights)).otherwise(F.col("_best.shard"))
    else:
        moved = rendezvous(key, grown)
    drawn = drawn.select(id_col, "size", "text_crc32", F.col("_best.shard").alias("shard"), moved.alias("grown_shard"))
    counted = drawn.groupBy(*drawn.columns).agg(F.count("*").alias("_copies"))
    placed = counted.withColumn("_order", F.md5(F.concat_ws(":", key, F.col("text_crc32").cast("string")))).withColumn("_prefix", F.substring("_order", 1, prefix_digits))
    counts = placed.groupBy("shard", "_prefix").agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    earlier = Window.partitionBy("shard", "_prefix").orderBy("_order", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    started = placed.withColumn("_start", F.coalesce(F.sum("_copies").over(earlier), F.lit(0))).join(first, ["shard", "_prefix"])
    # one row for each copy, by way of runs of bounded length
    runs = started.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(RUN).cast("long"))))
    copies = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + (RUN - 1), F.col("_copies") - 1))))
    slot = (F.col("_first") + F.col("_start") + F.col("_copy")).cast("long")
    return copies.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def oracle_sql(shards: int = SHARDS) -> str:
    """The registered query in DuckDB SQL, which has no CRC-32: the last lines of `sums` fold the bytes by table."""
    cost = "-ln((CAST('0x' || substr(md5(key || ':' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"
    best = lambda n: f"list_min(list_transform(range({n}), lambda i: {{'cost': {cost}, 'shard': i}})).shard"
    return f"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) t(i))
), keyed AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT doc_id, key, CAST(length(h) / 2 + {RECORD_OVERHEAD} AS BIGINT) AS size,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(h) / 2 AS BIGINT)),
             lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM keyed, tab
), placed AS (
  SELECT *, {best(shards)} AS shard, {best(shards + 1)} AS grown_shard FROM sums
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(key || ':' || text_crc32), doc_id, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM placed"""
