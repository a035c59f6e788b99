"""Whole turns of a dialogue in batches: replies to queries, and voice queries routed, searched and attributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotegraph.functions import replies
from quotegraph.functions.dialogue import route
from quotegraph.operators.search import complete_quotes
from quotegraph.plans.shared import materialize

#: Characters of a quote by which it counts as shown.
MARK = 100


def respond(asked: DataFrame, results: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """``(query_id, response)`` for each of ``asked`` (query_id, intent, entity), with ``results`` (query_id, position, quote, author, work).

    Results whose first 100 characters ``shown`` (query_id, mark) has for that query are left out.
    Of a query no more than the first five results meet in a task.
    """
    left = results.withColumn("mark", F.substring("quote", 1, MARK))
    if shown is not None:
        left = left.join(shown.select("query_id", "mark").distinct(), ["query_id", "mark"], "left_anti")
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("_all"))
    found = left.groupBy("query_id").agg(F.count(F.lit(1)).alias("_found"))
    order = Window.partitionBy("query_id").orderBy("position", "quote", "author", "work")
    first = left.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= replies.MOST)
    first = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.struct("quote", "author", "work").alias("r")))), lambda x: x["r"]).alias("_results"))
    rows = asked.select("query_id", "intent", "entity").join(counts, "query_id", "left").join(found, "query_id", "left").join(first, "query_id", "left")
    intent, entity = F.col("intent"), F.col("entity")
    question = F.when(intent == "find_by_author", replies.author_question(F.coalesce(entity, F.lit(""))))
    text = F.when(question.isNotNull(), question).when(F.col("_all").isNull(), replies.nothing_found(intent, entity)).when(F.col("_found").isNull(), replies.ALL_SHOWN)
    return rows.select("query_id", text.otherwise(replies.reply(intent, entity, F.col("_results"), F.col("_found"))).alias("response"))


def answer_voice(transcripts: DataFrame, quotes: DataFrame, said: DataFrame, works: DataFrame) -> DataFrame:
    """``(query_id, intent, response_text, audio_text)`` for ``transcripts`` (query_id, query, speaker: a name or null).

    An ambiguous or too short transcript is asked back, and nothing is spoken; the others are
    searched, and the best completion of at most five is attributed.
    """
    routed = materialize(transcripts.select("query_id", "query", "speaker", route(F.col("query")).alias("route"), replies.routing_question(F.col("query")).alias("question")), "voice-routed")
    open_ = routed.filter("route = 'autocomplete'").select("query_id", "query")
    best = complete_quotes(quotes, said, works, open_, replies.MOST).filter("rank = 1").select("query_id", "quote", "author", "work")
    rows = routed.join(best, "query_id", "left")
    asks = F.col("route") == "clarification"
    answer = replies.spoken_reply(F.col("quote"), F.col("author"), F.col("work"), F.col("speaker"))
    return rows.select("query_id", F.when(asks, "clarification").otherwise("search").alias("intent"), F.when(asks, F.col("question")).otherwise(answer).alias("response_text"), F.when(~asks, F.coalesce("quote", F.lit(replies.NOT_HEARD))).alias("audio_text"))
