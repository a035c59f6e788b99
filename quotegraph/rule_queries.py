"""More registered queries: predicates, sinks, entity linking, pair rules, windows, dialogue sessions.

They register beside those of :mod:`quotegraph.queries` and use its derived graph.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotegraph.functions import dialogue, extract, score, text
from quotegraph.operators import dedup, graph, linking, search, sinks, vectors, votes
from quotegraph.plans.shared import fresh_path, materialize, spread
from quotegraph.queries import (
    DIRTY,
    FORMS,
    GRAPH,
    KEYS,
    ORACLES,
    QUERIES,
    SCORED,
    _asked,
    _shown_sql,
    dirtied,
    dup2_blocking_keys,
    ext1_page_facts,
    has_source,
    has_work,
    query,
    quotes,
    said,
    scored,
    table,
)
from quotegraph.streaming import ingest

__all__ = ["ORACLES", "QUERIES"]


# predicates and projections
@query("SELECT doc_id AS quote_id FROM documents WHERE source = 'src1'")
def prd1_equals(s, d):
    return table(s, d, "documents").filter(F.col("source") == "src1").select(F.col("doc_id").alias("quote_id"))


@query("SELECT doc_id AS quote_id, lang FROM documents WHERE lang IN ('en', 'de')")
def prd2_in_list(s, d):
    return quotes(s, d).filter(F.col("lang").isin("en", "de")).select("quote_id", "lang")


@query("SELECT doc_id AS quote_id, coalesce(lang, 'und') AS lang FROM documents")
def prd3_coalesce(s, d):
    return quotes(s, d).select("quote_id", F.coalesce("lang", F.lit("und")).alias("lang"))


@query("SELECT doc_id AS quote_id FROM documents WHERE length(text) >= 400")
def prd4_size(s, d):
    return quotes(s, d).filter(F.length("text") >= 400).select("quote_id")


@query("SELECT doc_id AS quote_id FROM documents WHERE regexp_full_match(text, '[A-Z].*[a-z]+ [a-z]+.*')")
def prd5_whole_match(s, d):
    return quotes(s, d).filter(text.full_match(F.col("text"), "[A-Z].*[a-z]+ [a-z]+.*")).select("quote_id")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'http') AND contains(url, '/en/')")
def prd6_starts_and_contains(s, d):
    return table(s, d, "pages").filter(F.col("url").startswith("http") & F.col("url").contains("/en/")).select("page_id")


@query(f"WITH {GRAPH} SELECT DISTINCT person, work FROM said JOIN has_work USING (quote_id) WHERE work <> 'Work 7'")
def prd8_conditional_edges(s, d):
    """Edges written only for quotes that have a work other than one."""
    work = F.when(F.col("work") != "Work 7", F.col("work"))
    found = said(s, d).join(has_work(s, d), "quote_id").select("person", work.alias("work"))
    return graph.upsert_edges(found.limit(0), found.filter("work IS NOT NULL"), ["person", "work"])


@query("SELECT DISTINCT source AS person, lang AS tongue FROM documents")
def prj1_distinct_alias(s, d):
    return table(s, d, "documents").select(F.col("source").alias("person"), F.col("lang").alias("tongue")).distinct()


@query("SELECT doc_id AS quote_id, text, NULL::VARCHAR AS lang FROM documents")
def prj3_remove_property(s, d):
    return quotes(s, d).withColumn("lang", F.lit(None).cast("string"))


# sinks
@query("SELECT doc_id AS quote_id, text FROM documents")
def snk1_write_and_swap(s, d):
    """Written twice to one place: the second table takes the first one's."""
    path = fresh_path(s, "swapped")
    graph.write_swap(quotes(s, d).select("quote_id").limit(5), path)
    graph.write_swap(quotes(s, d).select("quote_id", "text"), path)
    return s.read.parquet(path)


@query("SELECT doc_id AS node_id, doc_id % 7 AS cluster_id, count(*) OVER (PARTITION BY doc_id % 7) AS cluster_size, coalesce(source, 'Unknown') AS author, text[1:120] AS text_preview FROM documents")
def snk5_cluster_report(s, d):
    """The report of clusters as a CSV file, read back."""
    path = fresh_path(s, "report")
    ids = table(s, d, "documents").select(F.col("doc_id").alias("node"), (F.col("doc_id") % 7).alias("component"))
    sized = ids.join(ids.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    rows = table(s, d, "documents").select(F.col("doc_id").alias("quote_id"), F.col("source").alias("author"), "text")
    sinks.write_csv(sinks.cluster_report(sized, rows), path)
    return sinks.read_csv(s, path, "cluster_id long, cluster_size long, node_id long, author string, text_preview string")


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}', {})".format(q.replace("'", "''"), a, "NULL" if w == "Unknown" else f"'{w}'") for q, a, w in sinks.SAMPLE_QUOTES) + ") t(quote, author, work)")
def snk7_sample_quotes(s, d):
    return sinks.sample_quotes(s)


@query()
def src6_index_catalog(s, d):
    """Postings as a catalog table: created, found, read, dropped. No SQL: it is about the catalog."""
    name = "quotegraph_postings_" + fresh_path(s, "x").rsplit("-", 1)[1]
    before = graph.index_exists(s, name)
    search.postings(quotes(s, d)).createOrReplaceTempView(name)
    rows, during = s.table(name).count(), graph.index_exists(s, name)
    s.catalog.dropTempView(name)
    return s.createDataFrame([(before, during, graph.index_exists(s, name), rows)], "before boolean, during boolean, after boolean, postings long")


# entity linking
@query()
def jn5_linked_authors(s, d):
    known = s.createDataFrame([("ann example", "Ann E. Example")], "key string, name string")
    return linking.link_authors(dirtied(s, d), known).select("quote_id", "author", "confidence", "pattern", "is_reused")


_WORKS = [("a quiet title", "A Quiet Title", 1)]


@query(rf"""SELECT doc_id AS quote_id, CASE WHEN doc_id % 16 = 3 THEN 'A Quiet Title' ELSE 'Another Known One' END AS work, CASE WHEN doc_id % 16 = 3 THEN 'explicit_quotes_reused' ELSE 'explicit_quotes_new' END AS match_type
 FROM documents WHERE doc_id % 8 = 3""")
def ext6_linked_works(s, d):
    """Titles in quote marks, added to texts without any: one known, one new, one of a single word that is none."""
    base = quotes(s, d).filter("quote_id % 4 = 3").select("quote_id", F.expr("concat('x ', quote_id, CASE quote_id % 16 WHEN 3 THEN ' from the book \"A Quiet Title\"' WHEN 11 THEN ' from the poem \"Another Known One\"' ELSE ' in the book \"Single\"' END)").alias("text"))
    return linking.link_works(base, s.createDataFrame(_WORKS, "key string, name string, ord int")).select("quote_id", "work", "match_type")


@query()
def ext6_linked_works_whole(s, d):
    """The same over all documents: titles stand behind whole texts, and one is named without quote marks. No SQL: texts have titles of their own."""
    suffix = F.expr("CASE quote_id % 16 WHEN 3 THEN ' from the book \"A Quiet Title\"' WHEN 7 THEN ' in the book \"Single\"' WHEN 11 THEN ' from the poem \"Another Known One\"' WHEN 15 THEN ' as we read in a quiet title it is so' ELSE '' END")
    base = quotes(s, d).select("quote_id", F.concat(F.coalesce("text", F.lit("")), suffix).alias("text"))
    return linking.link_works(base, s.createDataFrame(_WORKS, "key string, name string, ord int")).select("quote_id", "work", "match_type")


@query(r"""SELECT title, CASE WHEN length(title) < 4 THEN 'too short' WHEN length(title) > 60 THEN 'too long' WHEN contains(lower(title), '.com') THEN 'url' WHEN len(regexp_extract_all(title, '\d')) >= 8 THEN 'digits'
 WHEN lower(title) IN ('volume', 'unknown') THEN 'blacklisted' WHEN lower(title) LIKE 'chapter %' THEN 'blacklisted prefix' WHEN NOT regexp_matches(title, '\p{Lu}') THEN 'no capital' END AS reason
 FROM (SELECT DISTINCT CASE doc_id % 6 WHEN 0 THEN 'Chapter ' || doc_id WHEN 1 THEN 'no capitals ' || source WHEN 2 THEN 'Volume' WHEN 3 THEN 'A.com ' || source WHEN 4 THEN 'N 1234567' || doc_id ELSE 'The ' || source END AS title FROM documents)""")
def ext5_work_reasons(s, d):
    title = F.expr("CASE doc_id % 6 WHEN 0 THEN concat('Chapter ', doc_id) WHEN 1 THEN concat('no capitals ', source) WHEN 2 THEN 'Volume' WHEN 3 THEN concat('A.com ', source) WHEN 4 THEN concat('N 1234567', doc_id) ELSE concat('The ', source) END")
    titles = table(s, d, "documents").select(title.alias("title")).distinct()
    return titles.select("title", extract.work_reject_reason(F.col("title")).alias("reason"))


@query("SELECT entity_type, count(*) AS n FROM (" + ORACLES["ext1_page_facts"] + ") GROUP BY entity_type")
def ext2_routed_pages(s, d):
    """Each page goes to one of three writers, by its type."""
    facts = ext1_page_facts(s, d)
    return graph.tagged_counts({kind: facts.filter(F.col("entity_type") == kind) for kind in ("Person", "Work", "Source")}).filter("n > 0").withColumnRenamed("label", "entity_type")


_NAMES = "SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN 'Page ' || doc_id WHEN 1 THEN source WHEN 2 THEN 'ABCD' WHEN 3 THEN 'A very long name of some thirty letters ' || lang ELSE 'Ann ' || source END AS name FROM documents"
_ALERT_SQL = "UNION ALL ".join(
    f"SELECT '{alert}' AS alert, count(*) AS n, array_to_string(list_sort(list(name))[1:5], '|') AS samples FROM names WHERE {test} HAVING count(*) > 0 "
    for alert, test in zip(linking.ALERTS, (r"regexp_matches(name, '\d')", "length(name) > 30", "name = upper(name) AND length(name) > 3", "NOT contains(name, ' ')", "regexp_full_match(name, '(?i).*(read more|unknown|anonymous|page|chapter|vol|http|www|press|book).*')"))
)


@query(f"WITH names AS ({_NAMES}) {_ALERT_SQL}")
def agg5_name_alerts(s, d):
    name = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('Page ', doc_id) WHEN 1 THEN source WHEN 2 THEN 'ABCD' WHEN 3 THEN concat('A very long name of some thirty letters ', lang) ELSE concat('Ann ', source) END")
    return linking.name_alerts(table(s, d, "documents").select(name.alias("name")).distinct()).select("alert", "n", F.array_join("samples", "|").alias("samples"))


@query(f"WITH {GRAPH} SELECT 'total' AS fact, count(*) AS n FROM quotes UNION ALL SELECT 'with author', count(DISTINCT quote_id) FROM said UNION ALL SELECT 'persons', count(DISTINCT person) FROM said UNION ALL SELECT 'reviewed', count(DISTINCT doc_id) FROM labels WHERE toxic = 1")
def ext8_extraction_report(s, d):
    reviewed = table(s, d, "labels").filter("toxic = 1").select("doc_id").distinct()
    return graph.tagged_counts({"total": quotes(s, d), "with author": said(s, d).select("quote_id").distinct(), "persons": said(s, d).select("person").distinct(), "reviewed": reviewed}).withColumnRenamed("label", "fact")


@query(f"WITH {GRAPH} SELECT name, max_by(role, quote_id) AS role FROM (SELECT person AS name, 'Person' AS role, quote_id FROM said UNION ALL SELECT work, 'Work', quote_id FROM has_work UNION ALL SELECT source, 'Source', quote_id FROM has_source WHERE source NOT IN (SELECT person FROM said)) GROUP BY name")
def snk3_upsert_all_kinds(s, d):
    source = has_source(s, d).join(said(s, d).select(F.col("person").alias("source")).distinct(), "source", "left_anti")
    rows = None
    for df, key, role in ((said(s, d), "person", "Person"), (has_work(s, d), "work", "Work"), (source, "source", "Source")):
        own = df.select(F.col(key).alias("name"), F.lit(role).alias("role"), F.col("quote_id").alias("seq"))
        rows = own if rows is None else rows.unionByName(own)
    return graph.upsert_nodes(rows.limit(0), rows, "name", "seq", ["role"])


# groups, picks, windows, sorts, sets
@query(f"WITH {FORMS} SELECT sha256(form)[1:16] AS quote_hash, count(*) AS n FROM forms WHERE length(form) >= 15 GROUP BY form HAVING count(*) > 1")
def agg6_repeated_hashes(s, d):
    groups = dedup.exact_form_groups(quotes(s, d)).filter("group_size > 1")
    return groups.groupBy("quote_hash").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, arg_max(doc_id, {'n': length(text), 'i': -doc_id}) AS longest FROM documents GROUP BY source")
def agg8_longest(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("longest"))


@query(f"WITH {KEYS} SELECT key, count(*) AS n FROM fair GROUP BY key")
def win3_fair_blocks(s, d):
    sizes = dup2_blocking_keys(s, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n").between(dedup.LEAST_BLOCK, dedup.MOST_BLOCK))


@query("SELECT doc_id AS quote_id, dense_rank() OVER (ORDER BY first) AS cluster FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)")
def win5_cluster_numbers(s, d):
    """Numbers of groups in the order of their first ids: one row a group is ranked, not all rows."""
    hashed = quotes(s, d).select("quote_id", F.sha2("text", 256).alias("h"))
    firsts = materialize(hashed.groupBy("h").agg(F.min("quote_id").alias("first")), "cluster-firsts")
    low, high = firsts.agg(F.min("first"), F.max("first")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) // 4096)  # 4,096 ranges of ids or some more
    spread = firsts.withColumn("_b", F.floor((F.col("first") - F.lit(low)) / width))
    before = spread.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_at", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))
    ranked = spread.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("first"))).join(before, "_b")
    return hashed.join(ranked.select("h", (F.col("_at") + F.col("_r")).alias("cluster")), "h").select("quote_id", "cluster")


@query("SELECT doc_id AS quote_id, lang FROM documents ORDER BY lang DESC NULLS FIRST, doc_id LIMIT 50")
def srt1_descending_nulls_first(s, d):
    return quotes(s, d).orderBy(F.desc_nulls_first("lang"), "quote_id").select("quote_id", "lang").limit(50)


_RANKED = ORACLES["ret1_bm25"]


@query(f"SELECT query_id, quote_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, quote_id) AS r FROM ({_RANKED})) JOIN documents ON doc_id = quote_id WHERE r <= 10 AND length(text) >= 200")
def srt2_limit_before_filter(s, d):
    """The ten best by rounded score, and only then the filter."""
    found = QUERIES["ret1_bm25"](s, d)
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "quote_id"))).filter("r <= 10")
    return quotes(s, d).join(graph.checked_broadcast(top), "quote_id").filter(F.length("text") >= 200).select("query_id", "quote_id")


@query("SELECT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def set1_union_and_difference(s, d):
    rows = table(s, d, "labels")
    both = rows.filter("quality = 0").select("doc_id").union(rows.filter("toxic = 1").select("doc_id")).distinct()
    return both.join(table(s, d, "documents").filter("lang = 'en'"), "doc_id", "left_anti")


# texts
@query("SELECT doc_id AS quote_id FROM documents WHERE lang = 'en' OR lang IS NULL")
def txt10_language_filter(s, d):
    """A text without a known language passes, as where detection fails."""
    return quotes(s, d).filter((F.col("lang") == "en") | F.col("lang").isNull()).select("quote_id")


@query()
def txt14_layered_form(s, d):
    return quotes(s, d).select("quote_id", text.layered_form(F.col("text")).alias("form"))


@query(r"SELECT doc_id AS quote_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}]')) AS tokens FROM documents")
def txt20_tokens(s, d):
    """Of every document; a null text has none."""
    return quotes(s, d).select("quote_id", F.coalesce(F.size(text.tokens(F.coalesce("text", F.lit("")))), F.lit(0)).cast("long").alias("tokens"))


# scores and retrieval
@query("SELECT doc_id AS quote_id, length(coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 AND text <> '' THEN text END, 'before ' || source, '')) AS n FROM documents")
def scr3_scored_text(s, d):
    own = F.expr("CASE doc_id % 3 WHEN 1 THEN text WHEN 2 THEN '' END")
    return table(s, d, "documents").select(F.col("doc_id").alias("quote_id"), F.length(score.scored_text(own, F.concat(F.lit("before "), "source"))).cast("long").alias("n"))


@query(r"""SELECT doc_id AS quote_id, round((0.2 + 0.1 * CASE WHEN length(text) < 100 THEN 1.5 WHEN length(text) < 200 THEN 1.2 WHEN length(text) < 300 THEN 1.0 ELSE 0.7 END
 + 0.5 * CASE WHEN doc_id % 3 = 0 THEN 4.0 WHEN doc_id % 3 = 1 THEN 1.3 ELSE 0.8 END + 0.1 * CASE WHEN doc_id % 2 = 0 THEN 1.2 ELSE 1.0 END
 + 0.1 * CASE WHEN len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) = 0 THEN 1.0 ELSE 1.0 + 0.5 * len(list_intersect(['the', 'of'], string_split_regex(lower(text), '\s+'))) / 2 END)
 * CASE WHEN starts_with(lower(text), 'the of') THEN 1.2 WHEN contains(lower(text)[1:50], 'the of') THEN 1.1 ELSE 1.0 END, 6) AS final_score FROM documents""")
def scr4_rerank_score(s, d):
    author = F.expr("CASE quote_id % 3 WHEN 0 THEN 'Mark Twain' WHEN 1 THEN 'Some Body' ELSE 'Unknown' END")
    work = F.expr("CASE WHEN quote_id % 2 = 0 THEN 'Some Work' END")
    return quotes(s, d).select("quote_id", F.round(score.rerank_score(F.lit("the of"), F.col("text"), author, work, F.lit(1.0)), 6).alias("final_score"))


@query()
def scr5_match_rank(s, d):
    rows = _asked(s, d).withColumn("other", F.expr("concat(substring(query, 1, 40), ' and more')"))
    return rows.select("query_id", F.round(score.match_rank(F.col("query"), F.col("other"), F.lit(1.0)), 6).alias("rank"))


@query("""SELECT a.vec_id AS id, CASE WHEN s >= 0.98 AND least(a.vec_id, 100) / 100 >= 0.90 THEN 'LIKELY_DUPLICATE — review and delete shorter' WHEN s >= 0.95 THEN 'SUSPICIOUS — compare carefully' ELSE 'POSSIBLE_VARIANT — may keep both' END AS advice
 FROM (SELECT vec_id, 0.9 + (vec_id % 100) / 1000.0 AS s FROM embeddings) a""")
def scr6_recommendation(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("CAST(0.9 + (vec_id % 100) / 1000.0 AS DOUBLE)").alias("s"))
    shorter = F.repeat(F.lit("x"), F.least(F.col("id"), F.lit(100)).cast("int"))
    return rows.select("id", score.recommendation(F.round("s", 9), shorter, F.repeat(F.lit("x"), F.lit(100))).alias("advice"))


@query()
def ret8_fuzzy_reranked(s, d):
    asked = materialize(_asked(s, d), "fuzzy-asked")
    found = search.search(lambda ids: scored(s, d, ids), said(s, d), has_work(s, d), asked, mode="fuzzy", texts=quotes(s, d))
    return search.rerank(asked, found).select("query_id", "rank", "quote", "author", F.round("final_score", 4).alias("final_score"))


@query()
def jn10_closest_names(s, d):
    names = table(s, d, "documents").select(F.concat(F.lit("Doctor "), "source").alias("name")).distinct()
    asked = names.select(F.col("name").alias("query_id"), F.concat(F.col("name"), F.lit("x")).alias("name"))
    return search.fuzzy_names(asked, names)


# pair rules
@query(f"WITH {KEYS}, f AS (SELECT quote_id, list_distinct(list_filter(words, lambda w: length(w) >= 9)) AS r FROM forms) SELECT a, b, len(list_intersect(x.r, y.r)) AS shared, CASE WHEN len(x.r) + len(y.r) = 0 THEN 0.0 ELSE round(len(list_intersect(x.r, y.r)) / (len(x.r) + len(y.r) - len(list_intersect(x.r, y.r))), 6) END::DOUBLE AS rare FROM pairs JOIN f x ON x.quote_id = a JOIN f y ON y.quote_id = b")
def sim3_rare_overlap(s, d):
    """Words of nine letters or more stand for the rare ones."""
    rare = materialize(quotes(s, d).select("quote_id", F.array_distinct(F.filter(dedup.word_list(text.dedup_form(F.col("text"))), lambda w: F.length(w) >= 9)).alias("r")), "rare-words")
    pairs = QUERIES["jn7_block_pairs"](s, d)
    both = pairs.join(rare.select(F.col("quote_id").alias("a"), F.col("r").alias("ra")), "a").join(rare.select(F.col("quote_id").alias("b"), F.col("r").alias("rb")), "b")
    return both.select("a", "b", F.size(F.array_intersect("ra", "rb")).cast("long").alias("shared"), F.round(dedup.rare_overlap(F.col("ra"), F.col("rb")), 6).alias("rare"))


@query()
def sim4_two_of_three(s, d):
    """Words of nine letters or more stand for the rare ones."""
    return votes.block_signals(materialize(spread(quotes(s, d).select("quote_id", "text")).select("quote_id", text.dedup_form(F.col("text")).alias("form")), "vote-forms"))


@query()
def sim5_sequence_ratio(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next")).filter("next IS NOT NULL")
    return c.select("conv_id", "turn", F.round(score.sequence_ratio(F.col("text"), F.col("next")), 6).alias("ratio"))


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sim6_cosine(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


@query("SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.0 END::DOUBLE AS similarity FROM embeddings")
def sim7_speaker_similarity(s, d):
    """Of a vector with itself, with its opposite, and with zeros."""
    sign = F.expr("CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END")
    e = table(s, d, "embeddings").withColumn("_s", sign).withColumn("other", F.transform("embedding", lambda x: x * F.col("_s")))
    return e.select("vec_id", (F.round(vectors.speaker_similarity(F.col("embedding"), F.col("other")), 6) + 0.0).alias("similarity"))


@query()
def sim8_minhash_signatures(s, d):
    forms = quotes(s, d).select("quote_id", text.dedup_form(F.col("text")).alias("form"))
    return dedup.minhash_signatures(forms).select("quote_id", F.sha2(F.array_join(F.col("signature").cast("array<string>"), ","), 256).alias("signature"))


@query(f"WITH {KEYS}, s AS (SELECT quote_id, form, list_distinct(words) AS w FROM forms), j AS (SELECT a, b, len(list_intersect(x.w, y.w)) AS i, len(x.w) + len(y.w) AS t, x.form AS fa, y.form AS fb FROM pairs JOIN s x ON x.quote_id = a JOIN s y ON y.quote_id = b) SELECT count(*) AS hits FROM j WHERE t > i AND i / (t - i) >= 0.75 AND i / (t - i) >= 0.9")
def dup3_pair_test(s, d):
    return dedup.near_pairs(quotes(s, d)).filter("jaccard >= 0.9").agg(F.count(F.lit(1)).alias("hits"))


@query()
def dup9_ingest_dedup(s, d):
    short = quotes(s, d).filter(text.passes_filter(F.col("text")))
    return dedup.ingest_dedup(short)


@query()
def dup8_stream_dedup(s, d):
    """The documents as a stream: cleaned, the first of each normal form kept, written and read."""
    source, out = fresh_path(s, "stream-in"), fresh_path(s, "stream-out")
    dirtied(s, d).withColumn("ts", F.timestamp_seconds(86400 + F.col("quote_id") % 60)).select("quote_id", "text", "ts").write.parquet(source)
    stream = s.readStream.schema("quote_id long, text string, ts timestamp").parquet(source)
    run = ingest.dedup_stream(ingest.clean_stream(stream, decode=False)).select("quote_hash").writeStream.format("parquet").option("checkpointLocation", fresh_path(s, "stream-state")).outputMode("append").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return s.read.schema("quote_hash string").parquet(out)


# dialogue, speakers
@query()
def nlu3_entities(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", dialogue.entity(F.col("text")).alias("entity")).filter("entity IS NOT NULL")


@query("SELECT doc_id AS quote_id, CASE doc_id % 4 WHEN 0 THEN 'Hamlet, Act III, Scene I' WHEN 1 THEN 'Source unknown' WHEN 2 THEN 'Some Work' ELSE 'The Iliad, Epic Poem' END AS info, doc_id % 4 IN (0, 3) AS famous FROM documents")
def nlu6_source_info(s, d):
    work = F.expr("CASE quote_id % 4 WHEN 0 THEN 'Hamlet' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Some Work' ELSE 'The Iliad' END")
    return quotes(s, d).select("quote_id", dialogue.source_info(work).alias("info"), dialogue.famous_work(F.lit("x"), work).alias("famous"))


@query("SELECT vec_id AS speaker, CASE WHEN vec_id % 2 = 0 THEN 'voice ' || label ELSE 'default' END AS voice_name, CASE WHEN vec_id % 2 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS speed FROM embeddings")
def spk2_voice_preferences(s, d):
    stored = vectors.store_preferences(F.concat(F.lit("voice "), F.col("label")), F.lit(1.5), F.lit(0.5))
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("speaker"), vectors.voice_preferences(F.when(F.col("vec_id") % 2 == 0, stored)).alias("v"))
    return rows.select("speaker", "v.voice_name", "v.speed")


@query(f"""WITH {SCORED} SELECT person AS author, count(*) AS n FROM scored JOIN said USING (quote_id) WHERE quality_bucket IN ('high_quality', 'review') AND {_shown_sql()} GROUP BY person""")
def jn1_shown_by_author(s, d):
    shown = scored(s, d).filter(score.display_filter(F.col("text"), F.col("quality_bucket"), F.col("is_canonical")))
    return shown.join(said(s, d), "quote_id").groupBy(F.col("person").alias("author")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id AS quote_id, length({DIRTY}) AS n FROM documents")
def prd4_dirty_size(s, d):
    return dirtied(s, d).select("quote_id", F.length("text").cast("long").alias("n"))
