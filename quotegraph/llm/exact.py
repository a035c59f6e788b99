"""Exact deduplication by a stateful stream.

A streaming aggregation holds one entry a digest in RocksDB, on disk, without a watermark, so
nothing expires: the digest, how many rows have it, and the least (doc_id, content locator). The
locator (file, row) names the stored row, and tells repeated rows with one id apart. The keyed
state is itself the result table, read by the state data source. On hits, digests that two rows or
more share, full texts are compared: rows are grouped by digest and whole text, with a partial
aggregate per task, so a large group of copies moves one row a task.

Only DataFrame operations run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegraph.llm.tables import located, own_columns, place, without
from quotegraph.plans.shared import forget, fresh_path, materialize

#: Digests of 32 bytes that may be broadcast: some 20 MB. Beyond it the join is shuffled.
BROADCAST_DIGESTS = 100_000


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed_state(slim: DataFrame, folder: str, bytes_per_batch: int) -> DataFrame:
    """Runs the stream over the written digests and reads its state."""
    spark = slim.sparkSession.newSession()  # the store's settings stay with the stream
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else megabytes lie reserved for each partition
    spark.conf.set("spark.sql.shuffle.partitions", slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = spark.readStream.schema(slim.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(slim._written_at)
    states = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(place()).alias("keeper"))
    query = states.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    value = slim.sparkSession.read.format("statestore").load(folder)
    count, keeper = (F.col("value").getField(f.name) for f in value.schema["value"].dataType.fields[-2:])
    return value.select(F.col("key.digest").alias("digest"), count.alias("group_size"), keeper["id"].alias("keep_id"), keeper["file"].alias("_keep_file"), keeper["row"].alias("_keep_row"))


def exact_groups(docs: DataFrame, digest=sha256, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored): the group of its text.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, and the locator _file, _row. Texts are
    equal when their normalised forms are; null and empty texts are equal. Of a group, the row with
    the least doc_id stays (an id goes before null, and of rows with one id the first by locator
    stays, so exactly one row a group has kept = true). keep_id is null only if no row of the group
    has an id. An empty table gives an empty result. Ids may be of any type that can be ordered.

    ``digest`` may be weak: rows whose digests collide are told apart by their whole texts.
    """
    return _groups(*located(docs, "exact-source"), digest, bytes_per_batch)


def _groups(docs: DataFrame, file: str, row: str, digest=sha256, bytes_per_batch: int = 64 << 30) -> DataFrame:
    whole = docs.select("doc_id", F.col(file).alias("_file"), F.col(row).alias("_row"), normalised(F.col("text")).alias("_text"))
    strong = digest is sha256
    sums = [digest(F.col("_text")).alias("digest")] + ([] if strong else [sha256(F.col("_text")).alias("sha")])
    slim = materialize(whole.select("doc_id", "_file", "_row", *sums), "exact-digests")
    if slim.isEmpty():
        state = slim.selectExpr("digest", "1L AS group_size", "doc_id AS keep_id", "_file AS _keep_file", "_row AS _keep_row")
    else:
        state = materialize(_keyed_state(slim, fresh_path(docs.sparkSession, "exact-state"), bytes_per_batch), "exact-keys")
    hits = state.filter("group_size > 1").select("digest")
    side = F.broadcast(hits) if hits.count() <= BROADCAST_DIGESTS else hits
    hashed = whole.withColumn("digest", digest(F.col("_text")))
    classes = hashed.join(side, "digest", "left_semi").groupBy("digest", "_text").agg(F.count(F.lit(1)).alias("n"))
    clashes = materialize(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "exact-clashes")

    sha = F.col("digest") if strong else F.col("sha")
    kept = (F.col("_file") == F.col("_keep_file")) & (F.col("_row") == F.col("_keep_row"))
    columns = ["doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"), "_file", "_row"]
    if clashes.isEmpty():
        forget(clashes)
        return slim.join(state, "digest").select(*columns)
    plain = slim.join(clashes, "digest", "left_anti").join(state, "digest").select(*columns)
    apart = hashed.join(clashes, "digest", "left_semi")
    owners = materialize(apart.groupBy("digest", "_text").agg(F.count(F.lit(1)).alias("group_size"), F.min(place()).alias("keeper")), "exact-owners").select("digest", "_text", "group_size", F.col("keeper.id").alias("keep_id"), F.col("keeper.file").alias("_keep_file"), F.col("keeper.row").alias("_keep_row"))
    resolved = apart.join(owners, ["digest", "_text"]).withColumn("sha", sha256(F.col("_text")))
    return plain.unionByName(resolved.withColumn("digest", F.col("sha")).select(*columns))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns, extra ones of any name too."""
    whole, file, row = located(docs, "exact-source")
    return without(whole, _groups(whole, file, row).filter("NOT kept"), file, row).select(*own_columns(docs))
