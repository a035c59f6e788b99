"""Sharding by proportional stratified interleaving, law ``rows``.

Rows of each source are shuffled by a seeded hash and ranked; rank r of n becomes the fractional
rank (2r + 1) / 2n; all rows are sorted by it and cut into shards whose counts differ by one at
most. Every stretch of the order holds the sources in their proportions, and so does every shard.

Ranks over all rows come without a single-task sort: hashes and fractional ranks are evenly spread,
so fixed ranges of them are even buckets; a row's rank is what stands in the buckets before, plus
its number within its own. A hot source is spread over all buckets. Only DataFrame operations run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegraph.llm.tables import located, part_place, spread_repeats
from quotegraph.plans.shared import forget, materialize

BUCKET_ROWS, MAX_BUCKETS = 256, 1 << 16


def _bucket_bits(rows: int) -> int:
    return max(4, min(MAX_BUCKETS.bit_length() - 1, (rows // BUCKET_ROWS).bit_length()))


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """``df`` with the 0-based rank in ``order`` within ``group`` and the group's size. ``bucket`` rises with the order."""
    at = Window.partitionBy(*group).orderBy(bucket)
    sizes = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    starts = materialize(sizes.withColumn("_before", F.sum("_n").over(at) - F.col("_n")).withColumn(total, F.sum("_n").over(Window.partitionBy(*group))).drop("_n"), "shard-starts")
    renamed = starts.select(*[F.col(c).alias(f"_{c}") for c in (*group, bucket)], "_before", total)
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)))
    same = F.lit(True)
    for c in (*group, bucket):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return numbered.join(renamed, same).withColumn(rank, F.col("_before") + F.col("_rn") - 1).drop("_rn", "_before", *[f"_{c}" for c in (*group, bucket)])


def interleave(docs: DataFrame, shards: int = 16, seed: int = 11, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, text_crc32, shard, slot, and the payload's place in the order.

    ``docs`` needs doc_id, source and the text column; others are ignored. A null text has size 1
    (no bytes plus one) and the checksum of the empty string. Null sources are a source of their
    own. Rows that share an id and a checksum take places by where they are stored, so they spread
    over buckets; each gets its own slot. Fewer rows than shards leave shards empty. An empty table
    gives an empty result. Ids may be of any type that can be ordered and cast to a string.
    """
    docs, file, row = located(docs, "shard-source")
    whole = F.coalesce(F.col(text), F.lit(""))
    drawn = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(whole))
    slim = materialize(docs.select("doc_id", "source", (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), drawn.alias("_h"), part_place(file, row).alias("_at")), "shard-rows")
    total = slim.count()
    bits = _bucket_bits(total)
    ties = [F.col(c) for c in ("doc_id", "text_crc32", "size")]
    hashed = spread_repeats(slim, "_h", "_at").drop("_at").withColumn("_b", F.shiftrightunsigned("_h", 64 - bits)).withColumn("_u", F.shiftrightunsigned("_h", 1))
    inside = _ranked(hashed, ["source"], "_b", [F.col("_u"), F.col("_h"), *ties], "_rank", "_of")
    place = (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_of")).cast("double")
    spread = inside.select("doc_id", "source", "size", "text_crc32", "_h", place.alias("fractional_rank"))
    spread = materialize(spread.withColumn("_c", F.least(F.floor(F.col("fractional_rank") * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")).withColumn("_all", F.lit(0)), "shard-order")
    order = [F.col("fractional_rank"), F.xxhash64(F.lit(seed), F.col("source")), F.col("source"), F.col("_h"), *ties]
    lined = _ranked(spread, ["_all"], "_c", order, "position", "rows")
    shard = F.expr(f"CAST((position * {shards}) div rows AS INT)")
    lined = lined.withColumn("shard", shard)
    first = F.expr(f"(shard * rows + {shards - 1}) div {shards}")
    forget(slim)
    return lined.withColumn("slot", F.col("position") - first).select("doc_id", "source", "size", "text_crc32", "fractional_rank", "position", "shard", "slot")
