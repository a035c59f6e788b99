"""Cleaning and exact dedup of a stream of quotes; the reference behaviour is a batch, this runs it continuously.

Row-wise cleaning is the same Column expression as in a batch. Dedup keeps keys for as long as the
watermark says, so state stays bounded; a repeat that comes later than that passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegraph.functions.text import dedup_form, full_clean
from quotegraph.operators.dedup import LEAST_LENGTH


def clean_stream(quotes: DataFrame, decode: bool = True) -> DataFrame:
    """``quotes`` with cleaned texts; rows that cleaning rejects are left out. Works on streams and tables."""
    return quotes.withColumn("text", full_clean(F.col("text"), decode)).filter("text IS NOT NULL")


def dedup_stream(quotes: DataFrame, time_col: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """The first of the quotes with one normal form within ``lateness``; short forms are left out."""
    keyed = quotes.withColumn("quote_hash", F.sha2(dedup_form(F.col("text")), 256)).filter(F.length(dedup_form(F.col("text"))) >= LEAST_LENGTH)
    return keyed.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(["quote_hash"])
