"""Page dumps in XML: a scan of pages, and the quotes on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegraph.functions.extract import page_facts
from quotegraph.functions.text import quote_lines

PAGE = "title string, ns string, revision struct<text: string>"


def read_pages(spark: SparkSession, path: str, namespace: str = "0") -> DataFrame:
    """``(title, text)`` of the pages of one namespace that have a text.

    The schema is given, so nothing is read to infer it. The default namespace of the XML elements
    needs no prefix. A page without a title, a namespace or a revision's text is left out, and so is
    one that isn't well-formed.
    """
    raw = spark.read.format("xml").schema(PAGE).option("rowTag", "page").option("mode", "DROPMALFORMED").option("ignoreSurroundingSpaces", "false").load(path)
    pages = raw.filter(F.trim("ns") == namespace).select("title", F.col("revision.text").alias("text"))
    return pages.filter("title IS NOT NULL AND text IS NOT NULL AND text <> ''")


def page_quotes(pages: DataFrame) -> DataFrame:
    """One row for each quote on each page (title, text), with what its page's categories say of it."""
    facts = pages.withColumn("_f", page_facts(F.col("title"), F.col("text"))).withColumn("quote", F.explode(quote_lines(F.col("text"))))
    return facts.select("title", "quote", "_f.entity_type", "_f.roles", "_f.real_author", "_f.categories")


def quotes_of(kind: str, quotes: DataFrame) -> DataFrame:
    """The quotes of one kind of page: Person, Work or Source."""
    return quotes.filter(F.col("entity_type") == kind)
