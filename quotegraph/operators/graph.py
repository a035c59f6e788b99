"""Graph maintenance: scans, expansions, upserts, deletes, statistics.

Nodes and edges are DataFrames; an edge table has a key column at each end. Writes are new tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes (as JSON text) of a dimension that may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, of ``size`` bytes together."""
    first = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("_size"))
    many, held = first.agg(F.count(F.lit(1)), F.sum("_size")).first()
    return F.broadcast(df) if many <= rows and (held or 0) <= size else df


def keyset_page(df: DataFrame, key: str, last, n: int) -> DataFrame:
    """The next ``n`` rows after ``last`` in key order."""
    return df.filter(F.col(key) > F.lit(last)).orderBy(key).limit(n)


def offset_page(df: DataFrame, key: str, skip: int, n: int) -> DataFrame:
    """``n`` rows after the first ``skip`` in key order."""
    return df.orderBy(key).offset(skip).limit(n)


def dictionary(names: DataFrame, key: Column, order: str, name: str = "name") -> DataFrame:
    """``(key, name)``: the last name by ``order`` for each non-empty key."""
    return names.select(key.alias("key"), F.col(name).alias("name"), F.col(order).alias("_o")).filter("key <> ''").groupBy("key").agg(F.max_by("name", F.struct("_o", "name")).alias("name"))


def apply_updates(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` overwritten, by null too, where ``updates`` has the key."""
    new = updates.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(new, base[key] == new["_k"], "left")
    out = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(base[c]).alias(c) if c in columns else base[c] for c in base.columns]
    missing = [F.col(f"_new_{c}").alias(c) for c in columns if c not in base.columns]
    return joined.select(*out, *missing)


def upsert_nodes(base: DataFrame, incoming: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Nodes by key, new ones added; ``columns`` are those of the last writer by ``seq``."""
    both = base.select(key, *columns, F.lit(None).cast("long").alias("_seq")).unionByName(incoming.select(key, *columns, F.col(seq).cast("long").alias("_seq")))
    last = F.max_by(F.struct(*columns), F.struct(F.coalesce("_seq", F.lit(-1)), *columns)) if columns else F.struct(F.lit(0).alias("_"))
    return both.groupBy(key).agg(last.alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in columns])


def upsert_edges(base: DataFrame, incoming: DataFrame, ends: list[str]) -> DataFrame:
    return base.select(*ends).unionByName(incoming.select(*ends)).dropDuplicates(ends)


def detach_delete(nodes: DataFrame, key: str, ids: DataFrame, edges: list[tuple[DataFrame, list[str]]]) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes without ``ids``, and each edge table without the edges that touch one of them."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    left = nodes.join(gone, nodes[key] == gone["_gone"], "left_anti")
    kept = []
    for table, ends in edges:
        for end in ends:
            table = table.join(gone, table[end] == gone["_gone"], "left_anti")
        kept.append(table)
    return left, kept


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; empty if the key is unique."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def expand(start: DataFrame, edges: DataFrame, end: DataFrame, start_key: str, edge_start: str, edge_end: str, end_key: str, how: str = "inner") -> DataFrame:
    """One hop from ``start`` over ``edges`` to ``end``."""
    hop = start.join(edges, start[start_key] == edges[edge_start], how)
    return hop.join(end, edges[edge_end] == end[end_key], how)


def edge_flag(nodes: DataFrame, key: str, edges: DataFrame, end: str, name: str) -> DataFrame:
    """``nodes`` with a boolean column: whether an edge ends there."""
    ends = edges.select(F.col(end).alias("_end")).distinct().withColumn(name, F.lit(True))
    return nodes.join(ends, nodes[key] == ends["_end"], "left").drop("_end").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def tagged_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(label, n)`` of each table."""
    out = None
    for label, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def top_groups(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("edge_count")).orderBy(F.desc("edge_count"), key).limit(n)


def first_works(quotes: DataFrame, works: DataFrame, id_col: str = "quote_id", text_col: str = "text") -> DataFrame:
    """``(quote_id, work)``: the first work in load order that a quote's text names after in, from or quoted in.

    ``works`` has key, name and ord. A name counts if its key is longer than 8 characters, follows
    one of the phrases as a prefix of the text there, and doesn't follow `` by ``. A key starts with
    a word that the text may continue, so keys hash-join on all of their words but the last, and the
    rest is checked on the joined rows: no pair is made of a text and a work that share no words.
    """
    low = F.lower(F.col(text_col))
    keys = works.filter(F.length("key") > 8).select("key", "name", "ord", F.regexp_replace("key", "[^ ]+$", "").alias("_stem"), (F.size(F.split("key", " ")) - 1).alias("_n"))
    lengths = [r[0] for r in keys.select("_n").distinct().collect()]  # numbers of words of a title, a handful
    text = quotes.select(F.col(id_col), low.alias("_low"))
    words = F.split(F.col("_low"), " ", -1)
    starts = text.select(id_col, words.alias("_w"), F.posexplode(words).alias("_i", "_word")).filter(F.col("_word").isin("in", "from")).filter("_i > 0")
    hits = None
    for n in sorted(lengths):
        stem = F.concat_ws(" ", F.slice("_w", F.col("_i") + 2, n), F.lit("")) if n else F.lit("")
        rest = F.concat_ws(" ", F.slice("_w", F.col("_i") + 2, n + 1))
        part = starts.filter(F.size("_w") > F.col("_i") + n + 1).select(id_col, stem.alias("_at"), rest.alias("_rest"))
        own = checked_broadcast(keys.filter(F.col("_n") == n))
        if n == 0:
            part = part.join(own, F.col("_rest").startswith(F.col("key")))
        else:
            part = part.join(own, (F.col("_at") == F.col("_stem")) & F.col("_rest").startswith(F.col("key")))
        part = part.select(id_col, "key", "name", "ord")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return quotes.select(F.col(id_col), F.lit(None).cast("string").alias("work")).limit(0)
    safe = hits.distinct().join(text, id_col).filter(~F.col("_low").contains(F.concat(F.lit(" by "), F.col("key"))))
    return safe.groupBy(id_col).agg(F.min_by("name", "ord").alias("work"))


def rollback_extraction(quotes: DataFrame, said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undoes author extraction: texts restored, audit columns cleared, edges of extracted quotes dropped."""
    undone = F.coalesce(F.col("author_extracted"), F.lit(False))
    extracted = quotes.filter(undone).select("quote_id")
    restored = quotes.withColumn("text", F.when(undone, F.coalesce("text_before_extraction", "text")).otherwise(F.col("text")))
    for c in ("author_extracted", "text_before_extraction", "extraction_confidence", "extraction_pattern"):
        restored = restored.withColumn(c, F.lit(None).cast(quotes.schema[c].dataType))
    return restored, said.join(extracted, "quote_id", "left_anti")


def index_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def write_swap(df: DataFrame, path: str) -> None:
    """Writes next to ``path`` and then takes its place.

    A reader finds the old rows until the first rename and the new ones after the second; between
    the two, some milliseconds, the path isn't there. Raises if a rename fails, and then the old
    rows are at ``path`` or at ``path__old``.
    """
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    new, at, old = (jvm.Path(path + x) for x in ("__new", "", "__old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + "__new")
    if fs.exists(at):
        fs.delete(old, True)
        if not fs.rename(at, old):
            raise OSError(f"{path} can't be renamed")
    if not fs.rename(new, at):
        raise OSError(f"{path}__new can't take its place")
    fs.delete(old, True)


def first_of_block(df: DataFrame, key: str, order: str, n: int = 500) -> DataFrame:
    """The first ``n`` rows of each block; what the layered dedup compares in a large block."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_rn") <= n).drop("_rn")
