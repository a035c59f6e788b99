"""Entity linking: authors and works found in texts become edges, with a report on what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegraph.functions.extract import extract_author, quoted_title
from quotegraph.functions.text import person_key, title_key
from quotegraph.operators.graph import checked_broadcast, first_works

# Words that make a new person's name suspicious.
JUNK_NAME = r"(?i)\A.*(read more|unknown|anonymous|page|chapter|vol|http|www|press|book).*\z"
#: What is wrong with a name, in the order of the report.
ALERTS = ("Digits in name", "Long names (>30 chars)", "All Caps", "Single Word", "Junk/Metadata Keywords")


def link_authors(quotes: DataFrame, persons: DataFrame) -> DataFrame:
    """``(quote_id, quote, author, confidence, pattern, is_reused)`` of quotes that end in an attribution.

    ``persons`` is a dictionary (key, name) by :func:`person_key`; where it has the key, its name is
    the author's and the person is reused.
    """
    found = quotes.select("quote_id", extract_author(F.col("text")).alias("e")).filter("e IS NOT NULL").select("quote_id", "e.*").withColumn("key", person_key(F.col("author")))
    known = checked_broadcast(persons.select("key", F.col("name").alias("_known")))
    linked = found.join(known, "key", "left")
    return linked.select("quote_id", "quote", F.coalesce("_known", "author").alias("author"), "confidence", "pattern", F.col("_known").isNotNull().alias("is_reused"))


def link_works(quotes: DataFrame, works: DataFrame) -> DataFrame:
    """``(quote_id, work, match_type, confidence, is_reused)``: a known work that a text names, or one in quote marks.

    ``works`` has key (by :func:`title_key`), name and ord, a key once. A known work named in the
    text goes first; then a title in quote marks, reused if its key is known, new if it has two
    words or more.
    """
    named = first_works(quotes, works).select("quote_id", F.col("work").alias("_named"))
    titles = quotes.select("quote_id", quoted_title(F.col("text")).alias("title")).filter("title IS NOT NULL").withColumn("key", title_key(F.col("title")))
    known = checked_broadcast(works.select("key", F.col("name").alias("_known")))
    titled = titles.join(known, "key", "left").filter("_known IS NOT NULL OR size(filter(split(title, '\\\\s+'), w -> w <> '')) > 1").select("quote_id", "title", "_known")
    both = named.join(titled, "quote_id", "full")
    kind = F.when(F.col("_named").isNotNull(), "existing_work").when(F.col("_known").isNotNull(), "explicit_quotes_reused").otherwise("explicit_quotes_new")
    confidence = F.when(F.col("_named").isNotNull(), 0.98).when(F.col("_known").isNotNull(), 0.99).otherwise(0.95)
    return both.select("quote_id", F.coalesce("_named", "_known", "title").alias("work"), kind.alias("match_type"), confidence.alias("confidence"), (kind != "explicit_quotes_new").alias("is_reused"))


def name_alerts(names: DataFrame, samples: int = 5) -> DataFrame:
    """``(alert, n, samples)``: how many of the distinct ``names`` (name) are suspicious, with the first few.

    Samples are the least names; each task keeps only that many, so no group is collected whole.
    """
    name = F.col("name")
    tests = (name.rlike(r"\A.*\d+.*\z"), F.length(name) > 30, (name == F.upper(name)) & (F.length(name) > 3), ~name.contains(" "), name.rlike(JUNK_NAME))
    fired = F.array_compact(F.array(*[F.when(test, F.lit(alert)) for alert, test in zip(ALERTS, tests)]))
    hits = names.select("name", F.explode(fired).alias("alert"))
    counts = hits.groupBy("alert").agg(F.count(F.lit(1)).alias("n"))
    first = None
    for alert in ALERTS:
        few = hits.filter(F.col("alert") == alert).orderBy("name").limit(samples)
        first = few if first is None else first.unionByName(few)
    return counts.join(first.groupBy("alert").agg(F.array_sort(F.collect_list("name")).alias("samples")), "alert")
