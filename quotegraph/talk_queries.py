"""More registered queries: replies and voice queries, profiles, review queues, stored index, and SQL for extraction and dialogue rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotegraph.functions import dialogue, extract, replies, text
from quotegraph.operators import conversation, search, sinks, vectors
from quotegraph.operators.graph import checked_broadcast
from quotegraph.plans.shared import fresh_path, materialize, spread
from quotegraph.queries import _CLEAN, _FORM, DIRTY, _asked, dirtied, has_work, query, quotes, said, scored, table
from quotegraph.rule_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_text = lambda s: "'" + s.replace("'", "''") + "'"


# authors of quotes
_REASON = (
    r"CASE WHEN length({0}) < 4 THEN 'too short' WHEN length({0}) > 60 THEN 'too long' WHEN contains(lower({0}), 'http') OR contains(lower({0}), 'www.') OR contains(lower({0}), '.com') THEN 'url'"
    r" WHEN len(regexp_extract_all({0}, '\p{{Nd}}')) >= 4 THEN 'digits' WHEN lower({0}) IN ("
    + ", ".join(map(_text, extract.AUTHOR_BLACKLIST))
    + ") THEN 'blacklisted' WHEN "
    + " OR ".join("starts_with(lower({0}), " + _text(p) + ")" for p in extract.PREFIX_BLACKLIST)
    + r" THEN 'blacklisted prefix' WHEN NOT regexp_matches({0}, '\p{{Lu}}') THEN 'no capital' END"
)
_ATTRIBUTION = r"^(.*?)\s+(?:[—–\-~]\s*([A-Z][^\n]{4,50}?)|\(\s*([A-Z][^\n]{4,50}?)\s*\))\s*$"
EXTRACTED = f"""t AS (SELECT doc_id AS quote_id, {_STRIP.format(DIRTY)} AS bare FROM documents),
 g AS (SELECT quote_id, regexp_extract(bare, '{_ATTRIBUTION}', 1, 's') AS quote, regexp_extract(bare, '{_ATTRIBUTION}', 2, 's') AS dash, regexp_extract(bare, '{_ATTRIBUTION}', 3, 's') AS parens FROM t),
 a AS (SELECT *, {_STRIP.format(r"regexp_replace(trim(CASE WHEN dash <> '' THEN dash ELSE parens END), '[.,;:]$', '')")} AS author FROM g WHERE dash <> '' OR parens <> ''),
 extracted AS (SELECT quote_id, {_STRIP.format(r'''regexp_replace(''' + _STRIP.format("quote") + r''', '^["''“‘]+|["''”’]+$', '', 'g')''')} AS quote, author,
  CASE WHEN len(string_split_regex(author, '\\s+')) BETWEEN 2 AND 3 AND len(list_filter(string_split_regex(author, '\\s+'), lambda w: regexp_full_match(w, '\\p{{L}}+') AND NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0 THEN 0.98 ELSE 0.9 END::DOUBLE AS confidence,
  CASE WHEN dash <> '' THEN 'dash' ELSE 'parens' END AS pattern FROM a WHERE author <> '' AND {_REASON.format(r"trim(regexp_replace(author, '\s+', ' ', 'g'))")} IS NULL)"""
ORACLES["ext3_extract_author"] = f"WITH {EXTRACTED} SELECT * FROM extracted"
ORACLES["jn5_linked_authors"] = rf"""WITH {EXTRACTED}, k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(author), '[^\p{{L}}\p{{N}}_\s\-'']', '', 'g'), '\s+', ' ', 'g')) = 'ann example' AS is_reused FROM extracted)
 SELECT quote_id, CASE WHEN is_reused THEN 'Ann E. Example' ELSE author END AS author, confidence, pattern, is_reused FROM k"""

# words, sentences, rare words
ORACLES["agg9_rare_words"] = r"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY word),
 s AS (SELECT n, sum(count(*)) OVER (ORDER BY n) AS seen, sum(count(*)) OVER () AS total FROM w GROUP BY n), cut AS (SELECT least(20, min(n)) AS cut FROM s WHERE seen > least(greatest(1, floor(total * 0.05)), total - 1))
 SELECT word, n FROM w, cut WHERE n > 1 AND n <= cut"""


@query(
    r"""WITH t AS (SELECT doc_id AS quote_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}]') AS tokens, regexp_extract_all(text, '[^.!?]+[.!?]*') AS parts FROM documents)
 SELECT quote_id, len(tokens)::INT AS tokens, sha256(array_to_string(list_transform(list_filter(tokens, lambda t: regexp_matches(t, '^[\p{L}\p{N}_]')), lambda t: lower(t)), ' ')) AS normalised,
  len(list_filter(parts, lambda p: regexp_matches(p, '[^\s\p{Z}\x{85}\x{1c}-\x{1f}]')))::INT AS sentence_count FROM t"""
)
def txt20_processed(s, d):
    """Tokens, normalised text and sentences of every document."""
    rows = spread(quotes(s, d)).select("quote_id", text.processed(F.col("text")).alias("p"))
    return rows.select("quote_id", F.size("p.tokens").alias("tokens"), F.sha2("p.normalised", 256).alias("normalised"), "p.sentence_count")


@query(
    rf"""WITH m AS (SELECT doc_id AS quote_id, {DIRTY} AS t0 FROM documents), c AS (SELECT quote_id, t0, regexp_replace(regexp_replace(regexp_replace(t0, '\[\[|\]\]|\{{\{{|\}}\}}', '', 'g'), '''{{2,5}}', '', 'g'), '<[^>]+>', '', 'g') AS t FROM m),
 f AS (SELECT quote_id, t0, regexp_replace(regexp_replace(t, 'https?://\S+|www\.\S+', '', 'g'), '(?i)\[\d+\]|\[citation needed\]|\[note \d+\]', '', 'g') AS t FROM c)
 SELECT quote_id, CASE WHEN length({_STRIP.format("t0")}) >= 10 THEN trim(regexp_replace(regexp_replace(regexp_replace(translate(t, '«»‹›', chr(34) || chr(34) || chr(39) || chr(39)), '\s+', ' ', 'g'), ' +([.,!?;:])', '\1', 'g'), '([.,!?;:]) +', '\1 ', 'g')) END AS cleaned FROM f"""
)
def txt11_full_clean_plain(s, d):
    """The ingest chain but for entities and compatibility forms."""
    return dirtied(s, d).select("quote_id", text.full_clean(F.col("text"), decode=False).alias("cleaned"))


ORACLES["dup8_stream_dedup"] = "WITH forms AS (SELECT " + _FORM.replace("text", "cleaned") + f" AS form FROM ({ORACLES['txt11_full_clean_plain']}) WHERE cleaned IS NOT NULL) SELECT DISTINCT sha256(form) AS quote_hash FROM forms WHERE length(form) >= 15"


# dialogue rules
_BARE = _STRIP.format("text")
_starts = lambda words: "(" + " OR ".join(f"starts_with(lower({_BARE}), {_text(w)})" for w in words) + ")"
INTENT = (
    f"CASE WHEN {_BARE} = '' THEN 'general_query' WHEN regexp_matches({_BARE}, '[\"'']') OR {_starts(dialogue.QUOTE_STARTS)} OR contains({_BARE}, '...') OR ends_with({_BARE}, '…')"
    rf" OR (len(list_filter(string_split_regex({_BARE}, '\s+'), lambda w: w <> '')) <= 10 AND NOT {_starts(dialogue.QUESTION_STARTS)}) THEN 'quote_completion' "
    + " ".join(f"WHEN regexp_matches({_BARE}, " + _text("(?i)" + "|".join(f"(?:{p})" for p in patterns)) + f") THEN '{name}'" for name, patterns in dialogue.INTENTS)
    + " ELSE 'general_query' END"
)
_take = lambda pattern, strip=True: f"CASE WHEN regexp_matches(bare, {_text(pattern)}) THEN " + (_STRIP if strip else "{}").format(f"regexp_extract(bare, {_text(pattern)}, 1)") + " END"
ENTITY = f"""CASE intent WHEN 'quote_completion' THEN {_STRIP.format('''replace(replace(regexp_replace(bare, '^["'']+|["'']+$', '', 'g'), '...', ''), '…', '')''')}
 WHEN 'quote_attribution' THEN coalesce({_take('''["'](.+?)["']''', False)}, {_take("(?i)who (?:said|wrote) (.+)")})
 WHEN 'find_by_author' THEN coalesce({_take("(?:by|from) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)", False)}, {_take("([A-Z][a-z]+(?: [A-Z][a-z]+)+)", False)})
 WHEN 'find_by_work' THEN {_take("(?i)from (?:the )?(.+)")} WHEN 'quote_recommendation' THEN {_take("(?i)about (.+)")} WHEN 'general_query' THEN nullif(bare, '') END"""
_TURNS = f"WITH i AS (SELECT conv_id, turn, {_BARE} AS bare, {INTENT} AS intent FROM conversations)"
ORACLES["nlu2_intent"] = f"{_TURNS} SELECT conv_id, turn, intent, {ENTITY} AS entity FROM i"
ORACLES["nlu3_entities"] = f"{_TURNS} SELECT conv_id, turn, {ENTITY} AS entity FROM i WHERE ({ENTITY}) IS NOT NULL"
_request = lambda p: _STRIP.format(f"regexp_extract(text, {_text(p.replace('(?iu)', '(?i)'))}, 1)")
ORACLES["nlu4_requested_author"] = "SELECT conv_id, turn, coalesce(" + ", ".join(f"CASE WHEN length({_request(p)}) > 2 AND lower({_request(p)}) NOT IN ({', '.join(map(_text, dialogue.NO_AUTHOR))}) THEN {_request(p)} END" for p in dialogue.AUTHOR_REQUESTS) + ") AS author FROM conversations"
_UTTERANCES = "CASE turn % 9 WHEN 0 THEN 'who said \"' || text || '\"' WHEN 1 THEN 'Show me quotes by Ann Other Name and what they had said to all of them then' WHEN 2 THEN 'find quotes about ' || text WHEN 3 THEN 'give me a quote from the book of many pages that we have read long ago ' || turn WHEN 4 THEN 'what did Mark Twain say of it' WHEN 5 THEN 'surprise me with one of those that you have there and that I have not heard' WHEN 6 THEN '' WHEN 7 THEN text || '...' ELSE 'by the' END"


@query(f"{_TURNS.replace('FROM conversations', f'FROM (SELECT conv_id, turn, {_UTTERANCES} AS text FROM conversations)')} SELECT conv_id, turn, intent, {ENTITY} AS entity FROM i")
def nlu2_asked_intents(s, d):
    """Requests of every kind, made from the turns."""
    said_ = table(s, d, "conversations").select("conv_id", "turn", F.expr(_UTTERANCES.replace(" || ", " || ")).alias("text"))
    return said_.select("conv_id", "turn", dialogue.intent(F.col("text")).alias("intent"), dialogue.entity(F.col("text")).alias("entity"))


@query(ORACLES["nlu4_requested_author"].replace("FROM conversations", f"FROM (SELECT conv_id, turn, {_UTTERANCES} AS text FROM conversations)"))
def nlu4_asked_authors(s, d):
    said_ = table(s, d, "conversations").select("conv_id", "turn", F.expr(_UTTERANCES).alias("text"))
    return said_.select("conv_id", "turn", dialogue.requested_author(F.col("text")).alias("author"))


_MAP = "m(work, author, ord) AS (VALUES " + ", ".join(f"({_text(w)}, {_text(a)}, {i})" for i, (w, a) in enumerate(dialogue.WORK_AUTHORS.items())) + ")"
_NAMED = " OR ".join(f"contains(lower(a), '{n}')" for n in dialogue.FIRST_NAMES)
_MAPPED = f"""{_MAP}, p AS (SELECT doc_id, a, w, min_by(author, rank) AS mapped FROM (SELECT d.*, m.author, CASE WHEN m.work = lower(a) THEN 0 WHEN m.work = lower(w) THEN 1000 ELSE 2000 END + ord AS rank
  FROM d LEFT JOIN m ON contains(lower(a), m.work) OR contains(lower(w), m.work)) GROUP BY doc_id, a, w)
 SELECT doc_id, coalesce(mapped, nullif(a, ''), 'Unknown') AS author, CASE WHEN mapped IS NOT NULL OR {_NAMED} THEN 'high' WHEN a NOT IN ('', 'Unknown') THEN 'medium' ELSE 'low' END AS confidence FROM p"""
ORACLES["nlu5_mapped_author"] = f"WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Hamlet, Prince' WHEN 1 THEN source WHEN 2 THEN 'Unknown' ELSE 'Mark Other' END AS a, '' AS w FROM documents), {_MAPPED}"


@query(f"WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'the Prophet' WHEN 1 THEN '' WHEN 2 THEN source WHEN 3 THEN 'Walden, or the Iliad' ELSE 'Unknown' END AS a, CASE doc_id % 3 WHEN 0 THEN 'Hamlet' WHEN 1 THEN 'in the prince and the republic' ELSE '' END AS w FROM documents), {_MAPPED}")
def jn12_mapped_works(s, d):
    """Exact author, exact work, then the first entry that is part of either."""
    a = F.expr("CASE doc_id % 5 WHEN 0 THEN 'the Prophet' WHEN 1 THEN '' WHEN 2 THEN source WHEN 3 THEN 'Walden, or the Iliad' ELSE 'Unknown' END")
    w = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Hamlet' WHEN 1 THEN 'in the prince and the republic' ELSE '' END")
    return table(s, d, "documents").select("doc_id", dialogue.mapped_author(a, w).alias("m")).select("doc_id", "m.author", "m.confidence")


# replies
_INTENT_OF = "['quote_completion', 'quote_attribution', 'find_by_author', 'find_by_work', 'random_quote', 'quote_recommendation', 'general_query', 'find_by_author'][(item_id // 4) % 8 + 1]"
_line = lambda quote, rest: f"string_agg('**' || n || '.** \"' || {quote} || '\"\n' || {rest}, '' ORDER BY n) FILTER (n <= 5)"
_fmt = lambda template, *args: "format(" + _text(template.replace("{", "{{").replace("%s", "{}")) + "".join(f", {a}" for a in args) + ")"
_CUT_SQL = "CASE WHEN length(quote) <= 150 THEN quote ELSE quote[1:150] || '...' END"


@query(
    f"""WITH q AS (SELECT item_id AS query_id, {_INTENT_OF} AS intent, CASE WHEN (item_id // 4) % 8 <> 7 THEN 'hope ' || item_id WHEN item_id % 4 = 0 THEN 'The Poet' WHEN item_id % 4 = 1 THEN 'a king' WHEN item_id % 4 = 2 THEN 'Ann Example' END AS entity FROM benchmark),
 r AS (SELECT CASE WHEN doc_id % 4 = 0 THEN doc_id % 28 ELSE 28 + doc_id END AS query_id, doc_id, text AS quote, CASE doc_id % 3 WHEN 0 THEN 'Mark Other' WHEN 1 THEN source ELSE 'Unknown' END AS author,
  CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS sure, CASE WHEN doc_id % 2 = 0 THEN 'Work ' || n_chars % 50 END AS work FROM documents),
 seen AS (SELECT query_id, quote[1:100] AS mark FROM r WHERE query_id = 12 OR doc_id % 10 = 0),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM r WHERE (query_id, quote[1:100]) NOT IN (SELECT * FROM seen)),
 g AS (SELECT query_id, count(*) AS found, min_by(quote, n) AS quote, min_by(author, n) AS author, min_by(sure, n) AS sure, arg_min({{'w': work}}, n).w AS work,
  {_line(_CUT_SQL, "'   — ' || author || coalesce(', *' || work || '*', '') || '\n\n'")} AS several, {_line('quote', "coalesce('   *Source: ' || work || '*\n', '') || '\n'")} AS by_author, {_line('quote', "'\n'")} AS by_work, {_line('quote', "'   — ' || author || '\n\n'")} AS about FROM f GROUP BY query_id)
SELECT q.query_id, CASE WHEN intent = 'find_by_author' AND entity = 'The Poet' THEN {_text(replies.AUTHOR_QUESTIONS['poet'])} WHEN intent = 'find_by_author' AND entity = 'a king' THEN {_fmt(replies.AUTHOR_VAGUE, 'entity')}
 WHEN q.query_id NOT IN (SELECT query_id FROM r) THEN CASE intent WHEN 'find_by_author' THEN {_fmt(replies.NONE_BY_AUTHOR, "coalesce(entity, 'that author')")} WHEN 'quote_completion' THEN {_text(replies.NONE_TO_COMPLETE)} ELSE {_text(replies.NONE_FOUND)} END
 WHEN found IS NULL THEN {_text(replies.ALL_SHOWN)}
 WHEN intent = 'quote_completion' AND found = 1 THEN '**Quote:** "' || quote || '"\n\n**Source:** ' || author || coalesce(' (from *' || work || '*)', '') || CASE sure WHEN 'medium' THEN '\n\n*Note: Commonly attributed to this author*' WHEN 'low' THEN '\n\n*Note: Attribution uncertain - verify independently*' ELSE '' END
 WHEN intent = 'quote_completion' THEN '**Found ' || found || ' matching quotes:**\n\n' || several
 WHEN intent = 'quote_attribution' THEN '**Author:** ' || author || '\n\n' || coalesce('**Source:** ' || work || '\n\n', '') || '**Quote:** "' || quote || '"\n\n' || CASE sure WHEN 'medium' THEN '*Note: This quote is commonly attributed to this author.*\n' WHEN 'low' THEN '*Note: Attribution uncertain. Please verify independently.*\n' ELSE '' END
 WHEN intent = 'find_by_author' THEN '**Quotes by ' || author || ':**\n\n' || by_author || CASE WHEN found > 5 THEN '\n*(' || (found - 5) || ' more quotes available)*' ELSE '' END
 WHEN intent = 'find_by_work' THEN '**Quotes from** *' || entity || '*:\n\n' || by_work || CASE WHEN found > 5 THEN '\n*(' || (found - 5) || ' more quotes available)*' ELSE '' END
 WHEN intent = 'random_quote' THEN '**Random Quote:**\n\n"' || quote || '"\n\n— **' || author || '**' || coalesce(', *' || work || '*', '')
 WHEN intent = 'quote_recommendation' THEN '**Quotes about** *' || entity || '*:\n\n' || about ELSE '**Search Results:**\n\n' || several END AS response FROM q LEFT JOIN g ON g.query_id = q.query_id"""
)
def nlu7_responses(s, d):
    """Replies of every kind: with many results, one, none, and all of them shown."""
    asked = table(s, d, "benchmark").selectExpr(
        "item_id AS query_id",
        "element_at(array('quote_completion', 'quote_attribution', 'find_by_author', 'find_by_work', 'random_quote', 'quote_recommendation', 'general_query', 'find_by_author'), CAST((item_id div 4) % 8 + 1 AS INT)) AS intent",
        "CASE WHEN (item_id div 4) % 8 <> 7 THEN concat('hope ', item_id) WHEN item_id % 4 = 0 THEN 'The Poet' WHEN item_id % 4 = 1 THEN 'a king' WHEN item_id % 4 = 2 THEN 'Ann Example' END AS entity",
    )
    results = table(s, d, "documents").selectExpr(
        "CASE WHEN doc_id % 4 = 0 THEN doc_id % 28 ELSE 28 + doc_id END AS query_id", "doc_id AS position", "text AS quote", "CASE doc_id % 3 WHEN 0 THEN 'Mark Other' WHEN 1 THEN source ELSE 'Unknown' END AS author", "CASE WHEN doc_id % 2 = 0 THEN concat('Work ', n_chars % 50) END AS work"
    )
    shown = results.filter("query_id = 12 OR position % 10 = 0").select("query_id", F.substring("quote", 1, conversation.MARK).alias("mark"))
    return conversation.respond(asked, results, shown)


@query()
def voi3_voice_answers(s, d):
    """The benchmark texts as transcripts, some of them ambiguous or too short. No SQL: a whole search lies in between."""
    spoken = F.expr("CASE query_id % 5 WHEN 3 THEN concat('what did the poet say of ', query_id) WHEN 4 THEN ' ab ' ELSE query END")
    asked = _asked(s, d).select("query_id", spoken.alias("query"), F.when(F.col("query_id") % 2 == 0, F.lit("Ann")).alias("speaker"))
    return conversation.answer_voice(asked, scored(s, d), said(s, d), has_work(s, d))


# search results
# doubles throughout, added in the operator's order, so that ties are the same
_RERANK = r"""((((score * 2e-1 + CASE WHEN length(quote) < 100 THEN 1.5e0 WHEN length(quote) < 200 THEN 1.2e0 WHEN length(quote) < 300 THEN 1e0 ELSE 7e-1 END * 1e-1) + CASE author WHEN 'Mark Twain' THEN 4e0 WHEN 'Unknown' THEN 8e-1 ELSE 1.3e0 END * 5e-1) + CASE WHEN work IS NULL THEN 1e0 ELSE 1.2e0 END * 1e-1)
 + CASE WHEN len(list_filter(string_split_regex(lower(quote), '\s+'), lambda w: w <> '')) = 0 THEN 1e0 ELSE 1e0 + 5e-1 * len(list_intersect(['the', 'of'], string_split_regex(lower(quote), '\s+'))) / 2e0 END * 1e-1) * CASE WHEN starts_with(lower(quote), 'the of') THEN 1.2e0 WHEN contains(lower(quote)[1:50], 'the of') THEN 1.1e0 ELSE 1e0 END"""
_RESULTS = "r AS (SELECT doc_id % 7 AS query_id, doc_id AS position, text AS quote, CASE doc_id % 3 WHEN 0 THEN 'Mark Twain' WHEN 1 THEN source ELSE 'Unknown' END AS author, CASE WHEN doc_id % 2 = 0 THEN 'Some Work' END AS work, 1e0 / (1 + doc_id % 11) AS score FROM documents)"
_FIRST = f"first AS (SELECT * FROM r WHERE {_STRIP.format('quote')} <> '' QUALIFY row_number() OVER (PARTITION BY query_id, lower({_STRIP.format('quote')})[1:120], lower({_STRIP.format('author')}) ORDER BY position) = 1)"


def _results(s, d):
    return table(s, d, "documents").selectExpr("doc_id % 7 AS query_id", "doc_id AS position", "text AS quote", "CASE doc_id % 3 WHEN 0 THEN 'Mark Twain' WHEN 1 THEN source ELSE 'Unknown' END AS author", "CASE WHEN doc_id % 2 = 0 THEN 'Some Work' END AS work", "CAST(1 AS DOUBLE) / (1 + doc_id % 11) AS score")


@query(f"WITH {_RESULTS}, {_FIRST} SELECT query_id, position FROM first")
def set2_distinct_results(s, d):
    """The first result of each quote and author for each of seven queries."""
    return search.distinct_results(_results(s, d)).select("query_id", "position")


@query(f"WITH {_RESULTS}, {_FIRST} SELECT query_id, position, row_number() OVER (PARTITION BY query_id ORDER BY {_RERANK} DESC, position) AS rank FROM first QUALIFY rank <= 10")
def srt3_over_fetched(s, d):
    """More results than asked for: repeats dropped, reranked, cut."""
    asked = s.createDataFrame([(i, "the of") for i in range(7)], "query_id long, query string")
    found = search.rerank(asked, search.distinct_results(_results(s, d)), 10)
    return found.select("query_id", "position", F.col("rank").cast("long").alias("rank"))


@query("SELECT position FROM (SELECT doc_id AS position, 1 + doc_id % 11 AS score FROM documents) ORDER BY score DESC, position LIMIT 100")
def srt5_stable_sort(s, d):
    """Scores descending, ties by position."""
    return _results(s, d).select("position", (1 / F.col("score")).alias("score")).orderBy(F.desc(F.round("score", 6)), "position").limit(100).select("position")


@query(ORACLES["ret1_bm25"])
def src6_stored_index(s, d):
    """BM25 from an index that is created, found, replaced, asked, and dropped with the session's folder."""
    index = search.StoredIndex(s, fresh_path(s, "index"))
    if index.exists():
        raise ValueError("the folder is not fresh")
    index.create(quotes(s, d).limit(3))
    index.create(quotes(s, d), replace=True)
    asked = _asked(s, d).select("query_id", F.explode(search.terms(F.col("query"))).alias("term"))
    return index.score(asked).select("query_id", "quote_id", F.round("score", 4).alias("score"))


# vectors: nearest profiles, review pairs, profiles
_UNITS = "p AS (SELECT label::BIGINT AS speaker, min_by(embedding, vec_id) AS e FROM embeddings GROUP BY label)"


@query(f"""WITH {_UNITS}, s AS (SELECT vec_id, speaker, (list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(e::DOUBLE[], e::DOUBLE[])) + 1) / 2 AS s FROM embeddings, p)
 SELECT vec_id AS id, arg_max(speaker, {{'s': s, 'i': -speaker}}) AS neighbour, round(max(s), 4) AS similarity FROM s GROUP BY vec_id""")
def jn9_nearest_vector(s, d):
    e = table(s, d, "embeddings")
    profiles = e.groupBy(F.col("label").cast("long").alias("speaker")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return vectors.nearest_vector(e.select(F.col("vec_id").alias("probe_id"), "embedding"), profiles).select("id", "neighbour", F.round("similarity", 4).alias("similarity"))


REVIEWED = """n AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, a.label AS label, a.label = b.label AS same, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS position FROM embeddings a, embeddings b),
pairs AS (SELECT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b, round(max(s), 4) AS similarity FROM n WHERE position <= 11 AND id <> neighbour AND s >= 0.2 AND same GROUP BY ALL)"""


def _reviewed(s, d):
    """Pairs of vectors of one label, alike by 0.2 or more: the vectors are far apart."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("quote_id"), "embedding", F.col("label").cast("string").alias("author"))
    texts = quotes(s, d).select("quote_id", "text")
    return vectors.review_pairs(e.join(texts, "quote_id", "left").fillna({"text": ""}), 0.2)


@query(f"WITH {REVIEWED} SELECT * FROM pairs")
def dup7_review_pairs(s, d):
    return _reviewed(s, d).select("id_a", "id_b", "similarity")


@query(f"""WITH RECURSIVE {REVIEWED}, edges AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs), reach AS (SELECT DISTINCT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
 c AS (SELECT node, min(other) AS component FROM reach GROUP BY node) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def dup7_review_clusters(s, d):
    return vectors.review_clusters(_reviewed(s, d))


@query(f"WITH {REVIEWED}, t AS (SELECT vec_id AS id, label, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id) SELECT similarity, id_a, x.label::VARCHAR AS author_a, id_b, length(x.text) AS len_a, length(y.text) AS len_b FROM pairs JOIN t x ON x.id = id_a JOIN t y ON y.id = id_b")
def snk5_review_queue(s, d):
    """The queue as CSV files, read back; texts keep their line ends and quote marks."""
    path = fresh_path(s, "queue")
    sinks.write_review_queue(materialize(_reviewed(s, d), "queue-pairs"), path)
    rows = sinks.read_csv(s, path, "similarity double, recommendation string, id_a long, author_a string, text_a string, id_b long, author_b string, text_b string, len_a long, len_b long")
    return rows.select("similarity", "id_a", "author_a", "id_b", F.coalesce(F.length("text_a"), F.lit(0)).cast("long").alias("len_a"), F.coalesce(F.length("text_b"), F.lit(0)).cast("long").alias("len_b"))


@query("""SELECT vec_id AS speaker, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS name, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS sample_count, CASE WHEN vec_id % 5 = 0 THEN 'voice' ELSE 'default' END AS voice_name
 FROM embeddings WHERE vec_id % 7 <> 0""")
def spk1_profiles(s, d):
    """Profiles created, created again in vain, updated, deleted, listed and got."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("speaker"), F.lit("old").alias("name"), "embedding", F.when(F.col("vec_id") % 5 == 0, vectors.store_preferences(F.lit("voice"), F.lit(1.0), F.lit(0.0))).alias("voice_preferences"))
    at = lambda day: F.lit(f"2020-01-0{day} 00:00:00").cast("timestamp")
    profiles = vectors.create_profiles(vectors.create_profiles(None, e, at(1)), e.withColumn("name", F.lit("again")), at(2))
    profiles = vectors.update_profiles(profiles, e.filter("speaker % 3 = 0").withColumn("name", F.lit("new")), at(3))
    profiles = materialize(vectors.delete_profiles(profiles, e.filter("speaker % 7 = 0")), "profiles")
    listed = vectors.list_profiles(profiles).filter("last_seen = CASE WHEN speaker % 3 = 0 THEN TIMESTAMP'2020-01-03' ELSE TIMESTAMP'2020-01-01' END")
    voices = profiles.select("speaker", vectors.voice_preferences(F.col("voice_preferences"))["voice_name"].alias("voice_name"))
    return listed.join(voices, "speaker").select("speaker", "name", "sample_count", "voice_name")
