"""Registered queries of the graph operators, with their SQL.

The driver's tables become a graph: documents are quotes; a quote of an English or French document
is said by its source; one of at most 1,500 characters belongs to a work; one with a label has its
language as a source node. Cleaning and extraction get texts with a suffix that depends on the id,
so that their rules fire; the same expression is in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegraph.functions import dialogue, extract, score, text
from quotegraph.operators import dedup, graph, search, vectors
from quotegraph.operators.components import connected_components
from quotegraph.plans.shared import fresh_path, materialize, spread
from quotegraph.sources import pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("quote_id"), "text", "lang")


def said(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("lang").isin("en", "fr")).select(F.col("source").alias("person"), F.col("doc_id").alias("quote_id"))


def has_work(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("n_chars <= 1500").select(F.expr("concat('Work ', CAST(n_chars % 50 AS STRING))").alias("work"), F.col("doc_id").alias("quote_id"))


def has_source(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id").distinct()
    return table(spark, d, "documents").join(labelled, "doc_id", "left_semi").select(F.col("lang").alias("source"), F.col("doc_id").alias("quote_id"))


GRAPH = """quotes AS (SELECT doc_id AS quote_id, text, lang FROM documents),
said AS (SELECT source AS person, doc_id AS quote_id FROM documents WHERE lang IN ('en', 'fr')),
has_work AS (SELECT 'Work ' || (n_chars % 50)::VARCHAR AS work, doc_id AS quote_id FROM documents WHERE n_chars <= 1500),
has_source AS (SELECT lang AS source, doc_id AS quote_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""

#: What is added to a text, by its id modulo 8; the rest stays as it is.
SUFFIXES = (" (Page 12)", "[1] &nbsp;<b>x</b>", "... .... Read more", ' from the book "A Quiet Title"', " — Ann Example", " (Bob Other Name)", "[citation needed]")


def dirty() -> Column:
    out = None
    for i, suffix in enumerate(SUFFIXES):
        own = F.concat("text", F.lit(suffix))
        out = F.when(F.col("quote_id") % 8 == i, own) if out is None else out.when(F.col("quote_id") % 8 == i, own)
    return out.otherwise(F.col("text"))


DIRTY = "CASE doc_id % 8 " + " ".join("WHEN {} THEN text || '{}'".format(i, s.replace("'", "''")) for i, s in enumerate(SUFFIXES)) + " ELSE text END"


def dirtied(spark: SparkSession, d: str) -> DataFrame:
    return spread(quotes(spark, d)).withColumn("text", dirty())


def scored(spark: SparkSession, d: str, ids: DataFrame | None = None) -> DataFrame:
    """Quotes with their flags, score and bucket; only those of ``ids`` (quote_id), if given."""
    q = spread(quotes(spark, d))
    if ids is not None:
        q = q.join(graph.checked_broadcast(ids), "quote_id", "left_semi")
    for edges, name in ((said, "has_person"), (has_work, "has_work"), (has_source, "has_source")):
        q = graph.edge_flag(q, "quote_id", edges(spark, d), "quote_id", name)
    toxic = table(spark, d, "labels").groupBy(F.col("doc_id").alias("quote_id")).agg((F.max("toxic") == 1).alias("needs_review"))
    q = q.join(toxic, "quote_id", "left")
    s = score.quality_score(F.col("text"), F.col("has_person"), F.col("has_work"), F.col("has_source"), F.lit(None).cast("boolean"), F.col("needs_review"))
    return q.withColumn("_s", s).select(*q.columns, F.col("_s.score").alias("quality_score"), F.col("_s.bucket").alias("quality_bucket"), "_s.reasons", F.lit(None).cast("boolean").alias("is_canonical"))


_LEAK = r"""(regexp_matches(t, '(?i)p\.\s*\d+|pp\.\s*\d+|\[citation needed\]|\[[0-9]+\]|Read more|Continue reading')
 OR regexp_matches(t, '(?i)\{\{|\[\[|<ref|</ref|\|\s*[\p{L}\p{N}_]|\bFile:|\bImage:|==\s*[\p{L}\p{N}_]|&[a-z]+;|&#\d+;|\bCategory:'))"""
SCORED = (
    GRAPH
    + r""", flags AS (
SELECT q.*, q.text AS t, length(regexp_replace(q.text, '^\s+|\s+$', '', 'g')) AS n,
 q.quote_id IN (SELECT quote_id FROM said) AS has_person, q.quote_id IN (SELECT quote_id FROM has_work) AS has_work,
 q.quote_id IN (SELECT quote_id FROM has_source) AS has_source, coalesce(l.toxic = 1, false) AS needs_review
FROM quotes q LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = q.quote_id
), leaks AS (SELECT *, """
    + _LEAK
    + r""" AS leak FROM flags), points AS (
SELECT *, (2 * has_person::INT + 2 * has_work::INT + has_source::INT + (n BETWEEN 30 AND 300)::INT + (NOT leak)::INT - 2 * leak::INT
 - 2 * (n < 30)::INT - 2 * (n > 600)::INT - 3 * needs_review::INT
 - regexp_matches(t, '[.\-_]{5,}|^\s*\*|(?:(?:^|\s)[a-z]){5,}')::INT)::INT AS quality_score FROM leaks
), scored AS (SELECT *, CASE WHEN quality_score >= 5 THEN 'high_quality' WHEN quality_score >= 3 THEN 'review'
 WHEN quality_score >= 1 THEN 'low_quality' ELSE 'garbage' END AS quality_bucket FROM points)"""
)


# scans, updates, deletes
@query(f"WITH {GRAPH} SELECT quote_id, text FROM quotes")
def src2_label_scan(s, d):
    return quotes(s, d).select("quote_id", "text")


@query(f"WITH {GRAPH} SELECT quote_id FROM quotes WHERE quote_id > 50 ORDER BY quote_id LIMIT 100")
def src3_keyset_page(s, d):
    return graph.keyset_page(quotes(s, d), "quote_id", 50, 100).select("quote_id")


@query(f"WITH {GRAPH} SELECT quote_id FROM quotes ORDER BY quote_id LIMIT 60 OFFSET 40")
def src4_offset_page(s, d):
    return graph.offset_page(quotes(s, d), "quote_id", 40, 60).select("quote_id")


@query(r"""SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences FROM (
 SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term""")
def src5_postings(s, d):
    return search.postings(quotes(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


@query(r"""SELECT key, max_by(name, o) AS name FROM (SELECT trim(regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^\p{L}\p{N}_\s\-'']', '', 'g'), '\s+', ' ', 'g')) AS key,
 source || ' ' || lang AS name, doc_id AS o FROM documents) WHERE key <> '' GROUP BY key""")
def src7_dictionary(s, d):
    names = table(s, d, "documents").select(F.concat_ws(" ", "source", "lang").alias("name"), F.col("doc_id").alias("o"))
    return graph.dictionary(names, text.person_key(F.col("name")), "o")


@query("SELECT d.doc_id AS quote_id, CASE WHEN l.doc_id IS NOT NULL THEN NULL ELSE d.lang END AS lang, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def snk2_apply_updates(s, d):
    new = table(s, d, "labels").groupBy(F.col("doc_id").alias("quote_id")).agg(F.max("quality").alias("quality")).withColumn("lang", F.lit(None).cast("string"))
    return graph.apply_updates(quotes(s, d), new, "quote_id", ["lang", "quality"]).select("quote_id", "lang", "quality")


@query("SELECT source AS name, max_by(lang, doc_id) AS role FROM documents GROUP BY source")
def snk3_upsert_nodes(s, d):
    seen = table(s, d, "documents").select(F.col("source").alias("name"), F.col("lang").alias("role"), F.col("doc_id").alias("seq"))
    return graph.upsert_nodes(seen.limit(0), seen, "name", "seq", ["role"])


@query(f"WITH {GRAPH} SELECT DISTINCT person, work FROM said JOIN has_work USING (quote_id)")
def snk3_upsert_edges(s, d):
    wrote = said(s, d).join(has_work(s, d), "quote_id").select("person", "work")
    return graph.upsert_edges(wrote.limit(0), wrote, ["person", "work"])


@query(f"""WITH {GRAPH}, gone AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT 'quotes' AS label, count(*) AS n FROM quotes WHERE quote_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'said', count(*) FROM said WHERE quote_id NOT IN (SELECT doc_id FROM gone)""")
def snk4_detach_delete(s, d):
    left, (edges,) = graph.detach_delete(quotes(s, d), "quote_id", table(s, d, "labels").filter("quality = 0").select("doc_id"), [(said(s, d), ["quote_id"])])
    return graph.tagged_counts({"quotes": left, "said": edges})


@query("SELECT text AS key, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def snk6_key_violations(s, d):
    return graph.key_violations(quotes(s, d).select(F.col("text").alias("key")), "key")


# predicates
def _shown_sql(t: str = "text") -> str:
    return rf"""length({t}) >= 40 AND NOT regexp_full_match({t}, '.*\(\d{{4}}\).*') AND NOT regexp_full_match({t}, '.*p\. \d+.*') AND NOT regexp_full_match({t}, '.*https?://.*')
 AND NOT {t} LIKE 'http%' AND NOT contains({t}, '&c.') AND NOT regexp_full_match({t}, '.*ASIN:.*') AND NOT regexp_full_match({t}, '.*published in.*')"""


@query(f"WITH {SCORED} SELECT quote_id, quality_bucket FROM scored WHERE quality_bucket IN ('high_quality', 'review') AND {_shown_sql()}")
def prd9_display_filter(s, d):
    return scored(s, d).filter(score.display_filter(F.col("text"), F.col("quality_bucket"), F.col("is_canonical"))).select("quote_id", "quality_bucket")


@query(rf"""SELECT quote_id FROM (SELECT doc_id AS quote_id, {DIRTY} AS t FROM documents) WHERE regexp_full_match(t, '(?i).*(read more|see more|show more).*')
 OR regexp_full_match(t, '(?i).*(page |p\.|pp\.|vol\.|chapter ).*') OR regexp_full_match(t, '.*\[\d+\].*') OR regexp_full_match(t, '.*&[a-zA-Z]+;.*') OR regexp_full_match(t, '.*<[^>]+>.*')""")
def prd10_dirty_candidates(s, d):
    return dirtied(s, d).filter(text.dirty_candidate(F.col("text"))).select("quote_id")


@query("SELECT doc_id AS quote_id FROM documents WHERE contains(lower(text), lower('THE')) AND text LIKE 'T%'")
def prd7_contains_ignoring_case(s, d):
    return quotes(s, d).filter(F.lower("text").contains("the") & F.col("text").startswith("T")).select("quote_id")


@query("SELECT source AS person, list_aggregate(list_slice(list_sort(list(doc_id)), 1, 5), 'string_agg', ',') AS sample FROM documents GROUP BY source")
def prj2_sample_slice(s, d):
    """The first five quotes of each person; a task keeps no more of them."""
    rows = graph.first_of_block(table(s, d, "documents").select(F.col("source").alias("person"), "doc_id"), "person", "doc_id", 5)
    return rows.groupBy("person").agg(F.concat_ws(",", F.array_sort(F.collect_list("doc_id")).cast("array<string>")).alias("sample"))


# joins
@query(f"WITH {GRAPH} SELECT person, quote_id, length(text) AS n FROM said JOIN quotes USING (quote_id)")
def jn1_expand(s, d):
    hop = graph.expand(said(s, d).select("person").distinct(), said(s, d).toDF("_from", "_to"), quotes(s, d), "person", "_from", "_to", "quote_id")
    return hop.select("person", "quote_id", F.length("text").cast("long").alias("n"))


@query(f"WITH {GRAPH} SELECT quote_id, coalesce(person, 'Unknown') AS author, work FROM quotes LEFT JOIN said USING (quote_id) LEFT JOIN has_work USING (quote_id)")
def jn2_optional_match(s, d):
    return quotes(s, d).join(said(s, d), "quote_id", "left").join(has_work(s, d), "quote_id", "left").select("quote_id", F.coalesce("person", F.lit("Unknown")).alias("author"), "work")


@query(f"WITH {GRAPH} SELECT quote_id, quote_id IN (SELECT quote_id FROM said) AS has_person FROM quotes")
def jn3_exists_flag(s, d):
    return graph.edge_flag(quotes(s, d), "quote_id", said(s, d), "quote_id", "has_person").select("quote_id", "has_person")


@query(f"WITH {GRAPH} SELECT quote_id FROM quotes WHERE quote_id NOT IN (SELECT quote_id FROM said)")
def jn4_orphans(s, d):
    return quotes(s, d).join(said(s, d), "quote_id", "left_anti").select("quote_id")


@query(r"""WITH w AS (SELECT 'ther of the' AS key, 'A' AS name, 1 AS ord UNION ALL SELECT 'the other', 'B', 2 UNION ALL SELECT 'ananthere', 'C', 3 UNION ALL SELECT 'reti the an', 'D', 4),
q AS (SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' as quoted in the others' WHEN 1 THEN ' it is from reti the answer' WHEN 2 THEN ' in ananthere by ananthere' ELSE '' END) AS t FROM documents)
SELECT doc_id AS quote_id, min_by(name, ord) AS work FROM q, w WHERE length(key) > 8 AND (contains(t, ' in ' || key) OR contains(t, ' from ' || key)) AND NOT contains(t, ' by ' || key) GROUP BY doc_id""")
def jn6_work_in_text(s, d):
    works = s.createDataFrame([("ther of the", "A", 1), ("the other", "B", 2), ("ananthere", "C", 3), ("reti the an", "D", 4)], "key string, name string, ord int")
    more = F.expr("CASE quote_id % 4 WHEN 0 THEN ' as quoted in the others' WHEN 1 THEN ' it is from reti the answer' WHEN 2 THEN ' in ananthere by ananthere' ELSE '' END")
    return graph.first_works(quotes(s, d).withColumn("text", F.concat("text", more)), works)


_FORM = r"""trim(regexp_replace(translate(lower(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^["''“‘]+|["''”’]+$', '', 'g'), '^\s+|\s+$', '', 'g')),
 '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~“”‘’«»…', ''), '\s+', ' ', 'g'))"""
FORMS = f"""forms AS (SELECT quote_id, form, CASE WHEN form = '' THEN [] ELSE string_split(form, ' ') END AS words FROM (SELECT doc_id AS quote_id, {_FORM} AS form FROM documents))"""
KEYS = FORMS + r""", keyed AS (SELECT DISTINCT quote_id, unnest(['pfx:' || array_to_string(words[1:5], ' '), 'sfx:' || array_to_string(words[greatest(len(words) - 4, 1):], ' '),
 'len' || (length(form) // 10 * 10)::VARCHAR || ':' || array_to_string(list_sort(list_transform(list_sort(list_transform(words, lambda w, i: {'n': -length(w), 'i': i, 'w': w}))[1:3], lambda x: x.w)), '_')]) AS key
 FROM forms WHERE len(words) >= 3 AND length(form) >= 15),
fair AS (SELECT * FROM keyed WHERE key IN (SELECT key FROM keyed GROUP BY key HAVING count(*) BETWEEN 2 AND 500)),
pairs AS (SELECT DISTINCT x.quote_id AS a, y.quote_id AS b FROM fair x JOIN fair y ON x.key = y.key AND x.quote_id < y.quote_id)"""


@query(f"WITH {FORMS} SELECT quote_id, form FROM forms")
def txt13_dedup_form(s, d):
    return quotes(s, d).select("quote_id", text.dedup_form(F.col("text")).alias("form"))


@query(f"WITH {KEYS} SELECT quote_id, key FROM keyed")
def dup2_blocking_keys(s, d):
    keys = text.bind(text.dedup_form(F.col("text")), dedup.blocking_keys)
    return spread(quotes(s, d)).select("quote_id", F.explode(keys).alias("key")).distinct()


@query(f"WITH {KEYS} SELECT a, b FROM pairs")
def jn7_block_pairs(s, d):
    return dedup.block_pairs(dup2_blocking_keys(s, d))


_JACCARD = """sets AS (SELECT quote_id, list_distinct(words) AS w, form FROM forms), close AS (
 SELECT a, b, len(list_intersect(x.w, y.w)) AS i, len(x.w) + len(y.w) AS t, x.form AS form_a, y.form AS form_b FROM pairs JOIN sets x ON x.quote_id = a JOIN sets y ON y.quote_id = b
 WHERE least(len(x.w), len(y.w)) >= greatest(len(x.w), len(y.w)) * 0.75)"""


@query(f"WITH {KEYS}, {_JACCARD} SELECT a, b, round(i / (t - i), 4) AS jaccard FROM close WHERE i / (t - i) >= 0.9")
def sim1_jaccard_pairs(s, d):
    return dedup.near_pairs(quotes(s, d), edits=False).select("a", "b", F.round("jaccard", 4).alias("jaccard"))


@query(f"""WITH RECURSIVE {KEYS}, {_JACCARD}, hits AS (SELECT a, b FROM close WHERE i / (t - i) >= 0.9), edges AS (SELECT a, b FROM hits UNION SELECT b, a FROM hits),
reach AS (SELECT DISTINCT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other) SELECT node, min(other) AS component FROM reach GROUP BY node""")
def agg10_components(s, d):
    return connected_components(sim1_jaccard_pairs(s, d), "a", "b")


@query(f"""WITH {FORMS}, h AS (SELECT quote_id, sha256(form)[1:16] AS quote_hash FROM forms WHERE length(form) >= 15)
SELECT quote_id, quote_hash, count(*) OVER (PARTITION BY quote_hash) AS group_size, min(quote_id) OVER (PARTITION BY quote_hash) AS first_id FROM h""")
def dup1_exact_groups(s, d):
    return dedup.exact_form_groups(quotes(s, d)).select("quote_id", "quote_hash", "group_size", "first_id")


@query()
def dup4_dedup_updates(s, d):
    return dedup.dedup_updates(scored(s, d).select("quote_id", "text", "quality_score", "has_person", "has_work"))


@query(f"""WITH {SCORED}, {FORMS}, h AS (SELECT s.*, f.form FROM scored s JOIN forms f USING (quote_id) WHERE length(f.form) >= 15)
SELECT quote_id, form_rank = 1 AS first_pick FROM (SELECT quote_id, row_number() OVER (PARTITION BY form ORDER BY 1000 * has_person::INT + 500 * has_work::INT + 10 * quality_score DESC,
 least(abs(length(text) - 100), 500), quote_id) AS form_rank FROM h)""")
def win1_canonical_pick(s, d):
    q = scored(s, d).withColumn("form", text.dedup_form(F.col("text"))).filter(F.length("form") >= 15)
    order = dedup.canonical_order(F.col("has_person"), F.col("has_work"), F.col("quality_score"), F.col("text"))
    w = dedup.Window.partitionBy(F.sha2("form", 256)).orderBy(*order, "quote_id")
    return q.select("quote_id", (F.row_number().over(w) == 1).alias("first_pick"))


@query()
def dup5_layered_exact(s, d):
    return dedup.layered_exact(quotes(s, d))


@query()
def dup6_layered_near(s, d):
    return dedup.layered_near(quotes(s, d))


# aggregates
@query(f"""WITH {GRAPH} SELECT 'Quote' AS label, count(*) AS n FROM quotes UNION ALL SELECT 'Person', count(DISTINCT person) FROM said UNION ALL SELECT 'Work', count(DISTINCT work) FROM has_work
UNION ALL SELECT 'SAID', count(*) FROM said UNION ALL SELECT 'HAS_QUOTE', (SELECT count(*) FROM has_work) + (SELECT count(*) FROM has_source)""")
def agg1_statistics(s, d):
    quoted = has_work(s, d).select("quote_id").unionByName(has_source(s, d).select("quote_id"))
    return graph.tagged_counts({"Quote": quotes(s, d), "Person": said(s, d).select("person").distinct(), "Work": has_work(s, d).select("work").distinct(), "SAID": said(s, d), "HAS_QUOTE": quoted})


@query(f"WITH {GRAPH} SELECT person, count(*) AS edge_count FROM said GROUP BY person ORDER BY edge_count DESC, person LIMIT 10")
def agg2_most_quoted(s, d):
    return graph.top_groups(said(s, d), "person")


@query(f"WITH {GRAPH} SELECT count(*) AS total, count(*) FILTER (quote_id IN (SELECT quote_id FROM said)) AS with_said, count(*) FILTER (quote_id NOT IN (SELECT quote_id FROM said)) AS orphans FROM quotes")
def agg3_said_counts(s, d):
    q = graph.edge_flag(quotes(s, d), "quote_id", said(s, d), "quote_id", "p")
    return q.agg(F.count(F.lit(1)).alias("total"), F.count_if("p").alias("with_said"), F.count_if(~F.col("p")).alias("orphans"))


@query(r"""WITH c AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM c GROUP BY word),
r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM n), cut AS (SELECT least(20, max(n)) AS cut FROM r WHERE i = least(greatest(1, floor(total * 0.05)::BIGINT), total - 1))
SELECT word, n FROM n, cut WHERE n > 1 AND n <= cut""")
def agg9_rare_words(s, d):
    return dedup.rare_words(quotes(s, d).select(F.explode(search.terms(F.col("text"))).alias("word")))


# text rules
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html || ' [[A|b c]] ''''x'''' {{t}} [[D]]', '''{2,5}', '', 'g'), '\[\[(?:[^\]]*\|)?([^\]|]*)\]\]', '\1', 'g'), '\{\{[^}]+\}\}', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def txt1_wiki_text(s, d):
    return table(s, d, "pages").select("page_id", text.wiki_text(F.concat("html", F.lit(" [[A|b c]] ''x'' {{t}} [[D]]"))).alias("plain"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '\[\[|\]\]|\{\{|\}\}', '', 'g'), '''{2,5}', '', 'g'), '<[^>]+>', '', 'g') AS plain FROM pages")
def txt3_markup_remnants(s, d):
    return table(s, d, "pages").select("page_id", text.markup_remnants(F.col("html")).alias("plain"))


@query(r"SELECT page_id, regexp_replace(url || ' and www.x.org/y z', 'https?://\S+|www\.\S+', '', 'g') AS rest FROM pages")
def txt5_remove_urls(s, d):
    return table(s, d, "pages").select("page_id", text.remove_urls(F.concat("url", F.lit(" and www.x.org/y z"))).alias("rest"))


@query(rf"SELECT doc_id AS quote_id, regexp_replace({DIRTY}, '(?i)\[\d+\]|\[citation needed\]|\[note \d+\]', '', 'g') AS rest FROM documents")
def txt6_remove_footnotes(s, d):
    return dirtied(s, d).select("quote_id", text.remove_footnotes(F.col("text")).alias("rest"))


@query(r"SELECT doc_id AS quote_id, trim(regexp_replace(regexp_replace(regexp_replace(text || ' , x .y', '\s+', ' ', 'g'), '\s+([.,!?;:])', '\1', 'g'), '([.,!?;:])\s+', '\1 ', 'g')) AS tidy FROM documents")
def txt9_tidy_spaces(s, d):
    return quotes(s, d).select("quote_id", text.tidy_spaces(F.concat("text", F.lit(" , x .y"))).alias("tidy"))


_CLEAN = [
    r"&[a-z]+;|&#\d+;|</?[\p{L}\p{N}_]+[^>]*>|^\s*\*+\s*|^\s*=\s*",
    r"(?i)\[\d+\]|\[(?:citation needed|note \d+|source)\]",
    r"(?i)(?:\b(?:Read more|See more|Show more|Continue reading|Share|Copy|Tweet|Pin it)\b[.:\s]*)$|^(?:\b(?:Read more|See more|Show more)\b[.:\s]*)",
    r"(?i)(?:[(\[\-—]\s*)?(?:(?:p\.|pp\.|page|pages)\s*\d+(?:-\d+)?|(?:vol\.|volume)\s*\d+|(?:ch\.|chapter)\s*[\p{L}\p{N}_]+|(?:issue|edition)\s*\d+)(?:\s*[)\]])?\s*$",
    r"\.{4,}",
]
_STEPS = "".join(f", c{i + 1} AS (SELECT *, regexp_replace(t{i}, '{p}', '{'…' if i == 4 else ''}', 'g') AS t{i + 1}, regexp_matches(t{i}, '{p}') AS r{i + 1} FROM c{i})" for i, p in enumerate(_CLEAN))


@query(
    f"WITH c0 AS (SELECT doc_id AS quote_id, {DIRTY} AS t0 FROM documents){_STEPS}, f AS (SELECT *, "
    r"""regexp_replace(regexp_replace(trim(regexp_replace(replace(t5, chr(160), ' '), '\s+', ' ', 'g')), '^["''“‘]+|["''”’]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS cleaned,
 concat_ws(',', CASE WHEN r1 THEN 'HTML_JUNK' END, CASE WHEN r2 THEN 'WIKI_BRACKETS' END, CASE WHEN r3 THEN 'UI_JUNK' END, CASE WHEN r4 THEN 'SOURCE_METADATA' END, CASE WHEN r5 THEN 'EXCESSIVE_PUNCT' END) AS rules,
 length(regexp_replace(t0, '^\s+|\s+$', '', 'g')) AS n FROM c5)
SELECT quote_id, cleaned, rules, CASE WHEN length(cleaned) < 10 THEN 0.1 WHEN 1 - length(cleaned) / greatest(1, n) > 0.3 THEN 0.5 WHEN r3 OR r4 THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence FROM f WHERE rules <> ''"""
)
def txt12_in_place_clean(s, d):
    c = dirtied(s, d).select("quote_id", text.in_place_clean(F.col("text")).alias("c"))
    return c.select("quote_id", F.col("c.text").alias("cleaned"), F.concat_ws(",", "c.rules").alias("rules"), "c.confidence").filter("rules <> ''")


@query(r"""SELECT doc_id AS quote_id FROM documents WHERE length(text) BETWEEN 20 AND 500 AND NOT contains(text, 'http://') AND NOT contains(text, 'https://') AND NOT contains(text, 'www.')
 AND len(regexp_extract_all(text, '\p{L}')) >= length(text) * 0.5 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 3 AND len(regexp_extract_all(text, '[{}\[\]|<>]')) <= 5
 AND NOT regexp_matches(text, '(?i)^(?:\[.*\]$|File:|Image:|Retrieved|Archived|\{\{|\|)')""")
def txt18_quality_filter(s, d):
    return quotes(s, d).filter(text.passes_filter(F.col("text"))).select("quote_id")


@query(rf"SELECT lower(t) AS key, min(doc_id) AS quote_id FROM (SELECT doc_id, {_STRIP.format('text')} AS t FROM documents) WHERE length(t) >= 15 GROUP BY lower(t)")
def txt19_fast_ingest(s, d):
    q = quotes(s, d).select("quote_id", F.lower(text.fast_ingest_text(F.col("text"))).alias("key")).filter("key IS NOT NULL")
    return q.groupBy("key").agg(F.min("quote_id").alias("quote_id"))


@query()
def txt11_full_clean(s, d):
    return dirtied(s, d).select("quote_id", text.full_clean(F.col("text")).alias("cleaned"))


# extraction
@query()
def ext3_extract_author(s, d):
    e = dirtied(s, d).select("quote_id", extract.extract_author(F.col("text")).alias("e")).filter("e IS NOT NULL")
    return e.select("quote_id", "e.quote", "e.author", "e.confidence", "e.pattern")


@query(r"""SELECT name, CASE WHEN length(name) < 4 THEN 'too short' WHEN length(name) > 60 THEN 'too long' WHEN contains(lower(name), 'http') OR contains(lower(name), 'www.') OR contains(lower(name), '.com') THEN 'url'
 WHEN len(regexp_extract_all(name, '\d')) >= 4 THEN 'digits' WHEN lower(name) IN ('unknown', 'anonymous') THEN 'blacklisted' WHEN lower(name) LIKE 'page %' OR lower(name) LIKE 'from %' THEN 'blacklisted prefix'
 WHEN NOT regexp_matches(name, '\p{Lu}') THEN 'no capital' END AS reason FROM (SELECT DISTINCT trim(regexp_replace(CASE doc_id % 5 WHEN 0 THEN 'Page ' || doc_id WHEN 1 THEN source WHEN 2 THEN 'Anonymous' WHEN 3 THEN 'Ann ' || source ELSE 'N' || doc_id * 1001 END, '\s+', ' ', 'g')) AS name FROM documents)""")
def ext4_author_reasons(s, d):
    name = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('Page ', doc_id) WHEN 1 THEN source WHEN 2 THEN 'Anonymous' WHEN 3 THEN concat('Ann ', source) ELSE concat('N', doc_id * 1001) END")
    names = table(s, d, "documents").select(text.collapse(name).alias("name")).distinct()
    return names.select("name", extract.author_reject_reason(F.col("name")).alias("reason"))


@query(rf"""SELECT doc_id AS quote_id, regexp_extract({DIRTY}, '(?i)\bfrom the book\s+["“‘]([A-Z][^”’"]{{3,60}}?)["”’]', 1) AS title FROM documents WHERE regexp_matches({DIRTY}, '(?i)\bfrom the book\s+["“‘]([A-Z][^”’"]{{3,60}}?)["”’]')""")
def ext6_quoted_titles(s, d):
    return dirtied(s, d).select("quote_id", extract.quoted_title(F.col("text")).alias("title")).filter("title IS NOT NULL")


@query("SELECT doc_id AS quote_id, text FROM documents")
def ext7_rollback_is_identity(s, d):
    q = dirtied(s, d).join(quotes(s, d).select("quote_id", F.col("text").alias("text_before_extraction")), "quote_id")
    q = q.withColumn("author_extracted", F.lit(True)).withColumn("extraction_confidence", F.lit(0.9)).withColumn("extraction_pattern", F.lit("dash"))
    return graph.rollback_extraction(q, said(s, d))[0].select("quote_id", "text")


# scores
@query(f"WITH {SCORED} SELECT quote_id, quality_score, quality_bucket FROM scored")
def scr1_quality_score(s, d):
    return scored(s, d).select("quote_id", "quality_score", "quality_bucket")


@query(f"WITH {SCORED} SELECT coalesce(person, 'Unknown') AS person, quality_bucket AS bucket, count(*) AS n FROM scored LEFT JOIN said USING (quote_id) GROUP BY ALL")
def scr2_score_buckets(s, d):
    rows = scored(s, d).select("quote_id", "quality_bucket").join(said(s, d), "quote_id", "left")
    return rows.groupBy(F.coalesce("person", F.lit("Unknown")).alias("person"), F.col("quality_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# retrieval
def _asked(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(r"""WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), asked AS MATERIALIZED (SELECT item_id, term, count(*) AS asked FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM asked) GROUP BY ALL), f AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t), df AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT item_id AS query_id, doc_id AS quote_id, round(sum(asked * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 4) AS score FROM asked JOIN p USING (term) JOIN df USING (term), f GROUP BY ALL""")
def ret1_bm25(s, d):
    q = spread(quotes(s, d))
    asked = _asked(s, d).select("query_id", F.explode(search.terms(F.col("query"))).alias("term"))
    return search.bm25(search.postings(q), asked, *search.corpus_facts(q)).select("query_id", "quote_id", F.round("score", 4).alias("score"))


@query()
def ret4_complete_quotes(s, d):
    found = search.complete_quotes(scored(s, d), said(s, d), has_work(s, d), _asked(s, d))
    return found.select("query_id", "rank", "quote", "author", "work", F.round("final_score", 4).alias("final_score"))


@query(f"""WITH {SCORED}, r AS (SELECT lower(w.work) AS title, work, quote_id, coalesce(person, 'Unknown') AS author, quality_score AS score,
 row_number() OVER (PARTITION BY work ORDER BY quality_score DESC, length(text), quote_id) AS position FROM scored JOIN has_work w USING (quote_id) LEFT JOIN said USING (quote_id)
 WHERE quality_bucket IN ('high_quality', 'review') AND {_shown_sql()}) SELECT work, quote_id, author, score, position FROM r WHERE position <= 10""")
def ret6_find_by_work(s, d):
    """Each work asked for by its whole name, in capitals."""
    asked = has_work(s, d).select(F.col("work").alias("query_id"), F.upper("work").alias("title")).distinct()
    found = search.find_by_work(scored(s, d), said(s, d), has_work(s, d), asked, whole=True)
    return found.select("work", "quote_id", "author", "score", "position")


@query(f"WITH {SCORED} SELECT quote_id, person AS author FROM scored JOIN said USING (quote_id) WHERE quality_bucket = 'high_quality' ORDER BY md5(quote_id::VARCHAR || '|0'), quote_id, author LIMIT 5")
def srt4_random_quotes(s, d):
    return search.random_quotes(scored(s, d), said(s, d)).select("quote_id", "author")


# dialogue
@query("""SELECT conv_id, turn, CASE WHEN length(trim(text)) < 3 OR list_any_match(['the prophet', 'a prophet', 'the philosopher', 'a philosopher', 'the poet', 'a poet', 'the writer', 'a writer', 'the author', 'an author', 'the president', 'a president', 'the king', 'a king', 'the queen', 'a queen'], lambda t: contains(lower(text), t)) THEN 'clarification' ELSE 'autocomplete' END AS route FROM conversations""".replace("list_any_match(", "len(list_filter(").replace("lambda t: contains(lower(text), t))", "lambda t: contains(lower(text), t))) > 0"))
def nlu1_route(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", dialogue.route(F.col("text")).alias("route"))


@query()
def nlu2_intent(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", dialogue.intent(F.col("text")).alias("intent"), dialogue.entity(F.col("text")).alias("entity"))


@query()
def nlu5_mapped_author(s, d):
    rows = table(s, d, "documents").select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN 'Hamlet, Prince' WHEN 1 THEN source WHEN 2 THEN 'Unknown' ELSE 'Mark Other' END").alias("a"))
    return rows.select("doc_id", dialogue.mapped_author(F.col("a"), F.lit(None).cast("string")).alias("m")).select("doc_id", "m.author", "m.confidence")


# vectors
@query("""WITH p AS (SELECT label AS speaker, min_by(embedding, vec_id) AS e FROM embeddings GROUP BY label)
SELECT vec_id AS probe_id, round(max((list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(e::DOUBLE[], e::DOUBLE[])) + 1) / 2), 4) AS similarity FROM embeddings, p GROUP BY vec_id""")
def spk3_identify_speakers(s, d):
    e = table(s, d, "embeddings")
    profiles = e.groupBy(F.col("label").cast("long").alias("speaker")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return vectors.identify_speakers(e.select(F.col("vec_id").alias("probe_id"), "embedding"), profiles).select("probe_id", F.round("similarity", 4).alias("similarity"))


@query("""SELECT id, position, round(s, 4) AS similarity FROM (SELECT a.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS position FROM embeddings a, embeddings b) WHERE position <= 11""")
def jn8_nearest(s, d):
    return vectors.nearest(table(s, d, "embeddings"), 11).select("id", F.col("position"), F.round("similarity", 4).alias("similarity"))


# pages
_CATEGORIES = ("[[Category:American poets]] [[Category:1900 births]]", "[[Category:Novels by Ann Example|Key]]", "[[Category:Living people]]")
_CATEGORY_SQL = "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES)) + " ELSE '' END"


@query("SELECT page_id::VARCHAR AS title, url AS text FROM pages WHERE page_id % 4 <> 0 AND url <> ''")
def src1_page_dump(s, d):
    """Writes the urls as a dump of pages, a fourth of them in another namespace, and scans it."""
    path = fresh_path(s, "dump")
    ns = F.when(F.col("page_id") % 4 == 0, "1").otherwise("0")
    dump = table(s, d, "pages").select(F.col("page_id").cast("string").alias("title"), ns.alias("ns"), F.struct(F.col("url").alias("text")).alias("revision"))
    dump.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return pages.read_pages(s, path)


@query(
    rf"""WITH c AS (SELECT page_id, regexp_extract_all(html || ' ' || {_CATEGORY_SQL}, '\[\[Category:([^\n]*?)\]\]', 1) AS cats FROM pages),
w AS (SELECT page_id, cats, list_transform(cats, lambda c: lower(c)) AS low, list_filter(list_transform(cats, lambda c: regexp_extract(c, '(?i)(?:films|novels|plays|books|speeches|essays) by (.+)', 1)), lambda a: a <> '') AS made FROM c),
m(word, role) AS (VALUES """
    + ", ".join(f"('{k}', '{v}')" for k, v in extract.ROLES.items())
    + """), r AS (SELECT page_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM w, m WHERE len(list_filter(low, lambda c: contains(c, word))) > 0 GROUP BY page_id)
SELECT page_id, CASE WHEN len(made) > 0 THEN 'Work' WHEN roles IS NOT NULL OR len(list_filter(low, lambda c: contains(c, 'births') OR contains(c, 'deaths') OR contains(c, 'living people'))) > 0 THEN 'Person' ELSE 'Source' END AS entity_type,
 coalesce(roles, '') AS roles, trim(split_part(made[-1], '|', 1)) AS real_author FROM w LEFT JOIN r USING (page_id)"""
)
def ext1_page_facts(s, d):
    facts = extract.page_facts(F.col("url"), F.concat("html", F.lit(" "), F.expr(_CATEGORY_SQL)))
    return table(s, d, "pages").select("page_id", facts.alias("f")).select("page_id", "f.entity_type", F.concat_ws(",", "f.roles").alias("roles"), "f.real_author")


@query()
def txt2_page_quotes(s, d):
    """Every line of a document as a list item of a page."""
    lines = F.concat(F.lit("* "), F.replace("text", F.lit("\n"), F.lit("\n* ")))
    return pages.page_quotes(quotes(s, d).select(F.col("quote_id").alias("title"), lines.alias("text"))).select("title", "quote", "entity_type")


# more cleaning
@query()
def txt4_entities(s, d):
    return dirtied(s, d).select("quote_id", text.decode_entities(F.col("text")).alias("plain"))


@query()
def txt7_nfkc(s, d):
    return quotes(s, d).select("quote_id", text.nfkc(F.col("text")).alias("composed"))


@query("SELECT doc_id AS quote_id, translate('«' || text || '» ‹x›', '«»‹›', chr(34) || chr(34) || chr(39) || chr(39)) AS plain FROM documents")
def txt8_plain_marks(s, d):
    return quotes(s, d).select("quote_id", text.plain_marks(F.concat(F.lit("«"), "text", F.lit("» ‹x›"))).alias("plain"))


@query(r"SELECT doc_id AS quote_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s\x{a0}\-'']', '', 'g'), '\s+', ' ', 'g')) AS key FROM documents")
def txt15_person_key(s, d):
    return quotes(s, d).select("quote_id", text.person_key(F.col("text")).alias("key"))


@query(r"SELECT doc_id AS quote_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s\x{a0}]', '', 'g'), '\s+', ' ', 'g')) AS key FROM documents")
def txt16_title_key(s, d):
    return quotes(s, d).select("quote_id", text.title_key(F.col("text")).alias("key"))


@query(r"SELECT doc_id AS quote_id, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS key FROM documents")
def txt17_accent_key(s, d):
    return quotes(s, d).select("quote_id", text.accent_key(F.col("text")).alias("key"))


# more joins, aggregations, sets
@query(f"SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(rules, ',')) AS rule FROM ({ORACLES['txt12_in_place_clean']})) GROUP BY rule")
def agg4_rule_histogram(s, d):
    return txt12_in_place_clean(s, d).select(F.explode(F.split("rules", ",")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS quote_id, count(*) AS n FROM documents GROUP BY ALL")
def agg7_first_seen(s, d):
    return quotes(s, d).groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("quote_id").alias("quote_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT round(100.0 * (count(*) - count(DISTINCT text)) / greatest(1, count(*)), 6)::DOUBLE AS reduction, round(100.0 * count(*) FILTER (lang IN ('en', 'fr')) / greatest(1, count(*)), 6)::DOUBLE AS linked FROM documents")
def agg11_percentages(s, d):
    q = quotes(s, d).groupBy(F.sha2("text", 256).alias("h")).agg(F.count("text").alias("n"), F.count_if(F.col("lang").isin("en", "fr")).alias("linked"))
    total = F.greatest(F.lit(1), F.sum("n"))
    return q.agg(F.round(100 * (F.sum("n") - F.count("h")) / total, 6).alias("reduction"), F.round(100 * F.sum("linked") / total, 6).alias("linked"))


@query("SELECT conv_id, turn, round_even(length(text) / max(length(text)) OVER (PARTITION BY conv_id) * 100, 0)::INT AS percent FROM conversations WHERE text <> ''")
def agg12_relative_percent(s, d):
    c = table(s, d, "conversations").filter("text <> ''").withColumn("n", F.length("text"))
    top = F.max("n").over(dedup.Window.partitionBy("conv_id"))
    return c.withColumn("top", top).select("conv_id", "turn", score.relative_percent(F.col("n"), F.col("top")).alias("percent"))


@query(f"WITH {GRAPH} SELECT quote_id, count(*) AS edges, count(DISTINCT name) AS names FROM (SELECT quote_id, person AS name FROM said UNION ALL SELECT quote_id, work FROM has_work UNION ALL SELECT quote_id, source FROM has_source) GROUP BY quote_id")
def jn11_all_edges(s, d):
    edges = [e(s, d).select("quote_id", F.col(n).alias("name")) for e, n in ((said, "person"), (has_work, "work"), (has_source, "source"))]
    return edges[0].unionByName(edges[1]).unionByName(edges[2]).groupBy("quote_id").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("name").alias("names"))


@query("SELECT doc_id AS quote_id FROM documents WHERE text[1:100] NOT IN (SELECT text[1:100] FROM documents WHERE doc_id % 7 = 0)")
def set3_not_shown(s, d):
    """Quotes whose first 100 characters weren't shown; every seventh was."""
    q = quotes(s, d).withColumn("_mark", F.substring("text", 1, 100))
    return q.join(q.filter("quote_id % 7 = 0").select("_mark"), "_mark", "left_anti").select("quote_id")


@query("SELECT doc_id AS quote_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) <= 500")
def win2_first_of_block(s, d):
    return graph.first_of_block(table(s, d, "documents").select(F.col("doc_id").alias("quote_id"), "n_chars"), "n_chars", "quote_id")


@query("SELECT a.page_id, round(1 - levenshtein(a.url, b.url) / greatest(length(a.url), length(b.url)), 6) AS similarity FROM pages a JOIN pages b ON b.page_id = a.page_id + 1")
def sim2_edit_similarity(s, d):
    p = table(s, d, "pages").select("page_id", "url")
    pairs = p.join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other")), "page_id")
    return pairs.select("page_id", F.round(dedup.edit_similarity(F.col("url"), F.col("other")), 6).alias("similarity"))


# more retrieval
_TERMS = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents"


@query()
def ret2_fuzzy_terms(s, d):
    """No SQL: edits count characters here, and bytes in the other engine."""
    asked = _asked(s, d).select("query_id", F.explode(search.terms(F.col("query"))).alias("term")).distinct()
    return search.fuzzy_terms(search.postings(quotes(s, d)), asked).distinct()


@query(rf"WITH v AS ({_TERMS}), q AS (SELECT item_id, regexp_extract_all(lower(left(text, length(text) - 2)), '[\p{{L}}\p{{N}}]+') AS t FROM benchmark) SELECT item_id AS query_id, term FROM (SELECT item_id, unnest(t[1:len(t) - 1]) AS term FROM q) UNION SELECT item_id, term FROM q JOIN v ON starts_with(term, t[-1])")
def ret3_prefix_terms(s, d):
    asked = _asked(s, d).withColumn("query", F.expr("left(query, length(query) - 2)"))
    return search.prefix_terms(search.postings(quotes(s, d)), asked).distinct()


@query(f"""WITH {SCORED}, r AS (SELECT person AS author, quote_id, quality_score AS score,
 row_number() OVER (PARTITION BY person ORDER BY quality_score DESC, length(text), quote_id) AS position FROM scored JOIN said USING (quote_id)
 WHERE quality_bucket IN ('high_quality', 'review') AND {_shown_sql()}) SELECT author, quote_id, score, position FROM r WHERE position <= 10""")
def ret5_find_by_author(s, d):
    asked = said(s, d).select(F.col("person").alias("query_id"), F.col("person").alias("name")).distinct()
    return search.find_by_author(scored(s, d), said(s, d), has_work(s, d), asked).select("author", "quote_id", "score", "position")


# more dialogue and speakers
@query()
def nlu4_requested_author(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", dialogue.requested_author(F.col("text")).alias("author"))


@query(r"SELECT conv_id, turn, contains(a, b) OR contains(b, a) AS same FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS a, trim(regexp_replace(CASE turn % 2 WHEN 0 THEN '  ' || text ELSE text || '!' || role END, '\s+', ' ', 'g')) AS b FROM conversations)")
def nlu8_audio_matches(s, d):
    spoken = F.expr("CASE turn % 2 WHEN 0 THEN concat('  ', text) ELSE concat(text, '!', role) END")
    return table(s, d, "conversations").select("conv_id", "turn", dialogue.audio_matches(F.col("text"), spoken).alias("same"))


@query("SELECT vec_id AS speaker, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS name, 1 + (vec_id % 3 = 0)::INT AS sample_count FROM embeddings")
def spk1_update_profiles(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("speaker"), F.lit("old").alias("name"), "embedding", F.lit(1).alias("sample_count"))
    news = e.filter("speaker % 3 = 0").withColumn("name", F.lit("new"))
    return vectors.update_profiles(e, news).select("speaker", "name", "sample_count")
