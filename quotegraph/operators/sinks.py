"""Sinks for people who review: CSV reports; and the sample quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The sample quotes; a work of Unknown is none.
SAMPLE_QUOTES = (
    ("To be, or not to be, that is the question.", "William Shakespeare", "Hamlet"),
    ("I think, therefore I am.", "René Descartes", "Discourse on the Method"),
    ("The only thing we have to fear is fear itself.", "Franklin D. Roosevelt", "First Inaugural Address"),
    ("In the middle of difficulty lies opportunity.", "Albert Einstein", "Unknown"),
    ("The unexamined life is not worth living.", "Socrates", "Apology"),
    ("Be yourself; everyone else is already taken.", "Oscar Wilde", "Unknown"),
    ("Two things are infinite: the universe and human stupidity; and I'm not sure about the universe.", "Albert Einstein", "Unknown"),
    ("A room without books is like a body without a soul.", "Marcus Tullius Cicero", "Unknown"),
    ("You only live once, but if you do it right, once is enough.", "Mae West", "Unknown"),
    ("If you tell the truth, you don't have to remember anything.", "Mark Twain", "Unknown"),
)
QUEUE_COLUMNS = ("similarity", "recommendation", "id_a", "author_a", "text_a", "id_b", "author_b", "text_b", "len_a", "len_b")
_CSV = {"header": "true", "escape": '"', "quoteAll": "true", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def sample_quotes(spark: SparkSession) -> DataFrame:
    """``(quote, author, work)``; the work is null where it isn't known."""
    return spark.createDataFrame(SAMPLE_QUOTES, "quote string, author string, work string").withColumn("work", F.nullif("work", F.lit("Unknown")))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, quoted so that line ends and quote marks come back."""
    df.write.mode("overwrite").options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(multiLine="true", **_CSV).csv(path)


def write_review_queue(pairs: DataFrame, path: str) -> None:
    """The review pairs, most similar first. Files are in that order too; their number grows with the queue."""
    write_csv(pairs.select(*QUEUE_COLUMNS).orderBy(F.desc("similarity"), "id_a", "id_b"), path)


def cluster_report(clusters: DataFrame, quotes: DataFrame) -> DataFrame:
    """``(cluster_id, cluster_size, node_id, author, text_preview)`` of each member of ``clusters`` (node, component, size)."""
    rows = clusters.join(quotes.select(F.col("quote_id").alias("node"), "author", "text"), "node", "left")
    return rows.select(F.col("component").alias("cluster_id"), F.col("size").alias("cluster_size"), F.col("node").alias("node_id"), F.coalesce("author", F.lit("Unknown")).alias("author"), F.coalesce(F.substring("text", 1, 120), F.lit("")).alias("text_preview"))
