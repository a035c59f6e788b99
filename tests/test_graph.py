import difflib
import os
import random
import re
import unicodedata

from pyspark.sql import functions as F

from quotegraph.functions import dialogue, extract, score, text
from quotegraph.operators import conversation, dedup, graph, linking, search, sinks, vectors
from quotegraph.operators.components import connected_components
from quotegraph.sources import pages


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()[0]


def test_page_markup(spark):
    assert one(spark, text.wiki_text, "[[Albert Einstein|Einstein]] was a physicist") == "Einstein was a physicist"
    assert one(spark, text.wiki_text, "'''bold''' and ''italic''") == "bold and italic"


def test_cleaning(spark):
    assert '"test"' in one(spark, text.full_clean, "This is a &quot;test&quot; with &nbsp;entities")
    assert one(spark, text.full_clean, "Hi") is None
    assert one(spark, text.full_clean, "Multiple   spaces    here") == "Multiple spaces here"
    assert "https" not in one(spark, text.full_clean, "Check out https://example.com for more info")
    cleaned = one(spark, text.in_place_clean, "A quote that says something true (Page 35)")
    assert (cleaned["text"], cleaned["rules"], cleaned["confidence"]) == ("A quote that says something true", ["SOURCE_METADATA"], 0.95)
    assert one(spark, text.in_place_clean, None)["text"] is None


def test_author_extraction(spark):
    found = one(spark, extract.extract_author, '"Be the change you wish to see." — Mahatma Gandhi')
    assert (found["author"], found["confidence"], found["pattern"]) == ("Mahatma Gandhi", 0.98, "dash")
    assert one(spark, extract.extract_author, "Some long sentence stands here (Chapter 12)") is None


def test_scores(spark):
    rows = spark.createDataFrame([("x" * 50, True, False, None), ("x" * 50, True, True, None), ("x" * 20, False, False, None), ("x" * 50, True, True, False)], "t string, p boolean, w boolean, c boolean")
    s = score.quality_score(F.col("t"), F.col("p"), F.col("w"), F.lit(False), F.col("c"), F.lit(False))
    assert [(r[0], r[1]) for r in rows.select(s.alias("s")).select("s.score", "s.bucket").collect()] == [(4, "review"), (6, "high_quality"), (-1, "garbage"), (3, "review")]


def test_components_match_brute_force(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dedup_updates(spark):
    same = "the quick brown fox jumps over the lazy dog again and again until it is dark"
    rows = [(1, same, 0, False, False), (2, same.upper() + "!", 5, True, False), (3, same + " x", 0, False, False), (4, "short", 0, False, False), (5, "another text that has nothing to do with it", 0, False, False)]
    out = {r["quote_id"]: r for r in dedup.dedup_updates(spark.createDataFrame(rows, "quote_id long, text string, quality_score int, has_person boolean, has_work boolean")).collect()}
    assert 4 not in out
    assert out[2]["is_canonical"] and not out[1]["is_canonical"] and out[1]["canonical_quote_id"] == 2
    assert out[3]["duplicate_type"] == "near" and out[3]["canonical_quote_id"] == 2
    assert out[5]["is_canonical"] and out[5]["duplicate_group_id"] is None


def test_search_ranks_the_matching_quote_first(spark):
    words = "imagination is more important than knowledge in all of the world"
    quotes = spark.createDataFrame([(1, words, 6, "high_quality", None), (2, "a completely other text that is long enough to be shown here", 6, "high_quality", None)], "quote_id long, text string, quality_score int, quality_bucket string, is_canonical boolean")
    said = spark.createDataFrame([("Albert Einstein", 1)], "person string, quote_id long")
    works = spark.createDataFrame([], "work string, quote_id long")
    asked = spark.createDataFrame([(7, "imagination knowledge"), (8, "no")], "query_id long, query string")
    rows = search.complete_quotes(quotes, said, works, asked).collect()
    assert [(r["query_id"], r["author"]) for r in rows] == [(7, "Albert Einstein")]
    fuzzy = search.search(quotes, said, works, spark.createDataFrame([(1, "imaginatoin")], "query_id long, query string"), mode="fuzzy").collect()
    assert fuzzy[0]["quote"] == words
    assert search.search(quotes, said, works, spark.createDataFrame([(1, "important kno")], "query_id long, query string"), mode="prefix").count() == 1


def test_fuzzy_names(spark):
    names = spark.createDataFrame([("Niccolò Machiavelli",), ("Plato",)], "name string")
    asked = spark.createDataFrame([(1, "niccolo machiavelli"), (2, "Platon"), (3, "zzzz")], "query_id long, name string")
    assert {(r[0], r[1], r[2]) for r in search.fuzzy_names(asked, names).collect()} == {(1, "Niccolò Machiavelli", "exact_normalized"), (2, "Plato", "fuzzy")}


def test_dialogue(spark):
    assert one(spark, dialogue.route, "ab") == "clarification"
    assert one(spark, dialogue.route, "the philosopher said") == "clarification"
    assert one(spark, dialogue.intent, "Random quote") == "quote_completion"
    assert one(spark, dialogue.intent, "Show me Einstein quotes") == "find_by_author"
    assert one(spark, lambda c: dialogue.mapped_author(c, F.lit(None).cast("string")), "Hamlet, Prince of Denmark")["author"] == "William Shakespeare"
    assert one(spark, dialogue.requested_author, "quotes by Oscar Wilde") == "Oscar Wilde"


def test_speakers(spark):
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "probe_id long, embedding array<double>")
    profiles = spark.createDataFrame([(5, [0.0, 1.0]), (6, [1.0, 0.1])], "speaker long, embedding array<double>")
    got = {r["probe_id"]: r for r in vectors.identify_speakers(probes, profiles).collect()}
    assert got[1]["speaker"] == 6 and got[1]["identified"]
    assert got[2]["speaker"] is None and got[2]["similarity"] == 0.0


def test_updates_overwrite_with_null(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    new = spark.createDataFrame([(1, None)], "id long, x string")
    assert dict(graph.apply_updates(base, new, "id", ["x"]).collect()) == {1: None, 2: "b"}


def test_entry_runs_without_the_optional_subpackage():
    import __spark_entry__ as e

    assert "scr2_score_buckets" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_page_dump(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns>{}</page>"
    body = "<revision><text>{}</text></revision>"
    kept = "* A first quote that is long enough.\n* short\n[[Category:American poets]]\n[[Category:1900 births]]"
    rows = [page.format("Ann", 0, body.format(kept)), page.format("Talk", 1, body.format(kept)), page.format("Bare", 0, ""), page.format("Empty", 0, body.format("")), "<page><ns>0</ns>" + body.format(kept) + "</page>"]
    (tmp_path / "dump.xml").write_text('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">' + "\n".join(rows) + "</mediawiki>")
    found = pages.read_pages(spark, str(tmp_path / "dump.xml"))
    assert [tuple(r) for r in found.collect()] == [("Ann", kept)]
    quotes = pages.page_quotes(found)
    r = quotes.first()
    assert quotes.count() == 1 and r["quote"] == "A first quote that is long enough." and r["entity_type"] == "Person" and r["roles"]
    assert pages.quotes_of("Person", quotes).count() == 1 and pages.quotes_of("Work", quotes).count() == 0


def test_fuzzy_terms_match_brute_force(spark):
    words = ["aiç", "al", "all", "quote", "quotes", "qoute", "x", "ïx", "long", "along", "belong", "naïve", "naive"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    index = spark.createDataFrame([(w, 1) for w in words], "term string, quote_id long")
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "query_id long, term string")
    found = {tuple(r) for r in search.fuzzy_terms(index, asked).distinct().collect()}
    assert found == {(i, b) for i, a in enumerate(words) for b in words if edits(a, b) <= 2}


def test_shingles_and_signatures_match_brute_force(spark):
    rows = [(1, "abcabcd"), (2, "ab"), (3, ""), (4, "naïve 😀 x"), (5, "abcabcd")]
    forms = spark.createDataFrame(rows, "quote_id long, form string")
    got = {r[0]: set(r[1]) for r in forms.select("quote_id", dedup.shingles(F.col("form"))).collect()}
    assert got == {i: {t[j : j + 3] for j in range(len(t) - 2)} or {t} for i, t in rows}
    signed = {r[0]: r[1] for r in dedup.minhash_signatures(forms, 8).collect()}
    assert len(signed) == 5 and all(len(x) == 8 for x in signed.values()) and signed[1] == signed[5] != signed[2]


def test_works_are_linked(spark):
    works = spark.createDataFrame([("a quiet title", "A Quiet Title", 1)], "key string, name string, ord int")
    rows = [(1, "as we read in a quiet title it is so"), (2, 'from the book "A Quiet Title"'), (3, 'from the poem "Some New One"'), (4, 'in the book "Single"'), (5, None)]
    got = {r["quote_id"]: (r["work"], r["match_type"], r["is_reused"]) for r in linking.link_works(spark.createDataFrame(rows, "quote_id long, text string"), works).collect()}
    assert got == {1: ("A Quiet Title", "existing_work", True), 2: ("A Quiet Title", "explicit_quotes_reused", True), 3: ("Some New One", "explicit_quotes_new", False)}


def test_reports_come_back_from_csv(spark, tmp_path):
    pairs = spark.createDataFrame([(0.9, "x", 1, "a", 'say "hi",\n there ', 2, None, "t", 3, 4)], "similarity double, recommendation string, id_a long, author_a string, text_a string, id_b long, author_b string, text_b string, len_a int, len_b int")
    sinks.write_review_queue(pairs, str(tmp_path / "q"))
    back = sinks.read_csv(spark, str(tmp_path / "q"), "similarity double, recommendation string, id_a long, author_a string, text_a string")
    assert [tuple(r) for r in back.collect()] == [(0.9, "x", 1, "a", 'say "hi",\n there ')]


def test_voice_preferences(spark):
    rows = spark.createDataFrame([(1, '{"voice_name": "v", "speed": 1.5}'), (2, None), (3, "")], "i long, j string")
    got = {r[0]: tuple(r[1]) for r in rows.select("i", vectors.voice_preferences(F.col("j"))).collect()}
    assert got == {1: ("v", 1.5, None), 2: ("default", 1.0, 0.0), 3: ("default", 1.0, 0.0)}


def graph_tables(spark, folder, texts, asked=()):
    """The tables that the graph queries read: documents with these texts, benchmark with these queries."""
    rows = [(i, t, "en", f"Ann {i}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_fuzzy_rerank_asks_whole_texts(spark, tmp_path):
    from quotegraph.rule_queries import QUERIES

    wanted = "Imagination is more important than knowledge in all of the wide world."
    d = graph_tables(spark, tmp_path, [wanted, "Completely other prose stands here, long enough to be shown."], ["zzzzzzzz yyyyyyyy xxxxxxxx imaginatoin knowlegde"])
    found = QUERIES["ret8_fuzzy_reranked"](spark, d).collect()
    assert [(r["query_id"], r["rank"], r["quote"]) for r in found] == [(0, 1, wanted)]


def test_best_quotes_are_those_of_all_scores(spark, monkeypatch):
    """Each task's best are the best of the whole scores, ties by id, however few rows, products and queries it holds at once."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(80)]
    quotes = spark.createDataFrame(list(enumerate([*texts, None, *texts])), "quote_id long, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", rng.choice(words)) for i in range(12) for _ in range(9)] + [("none", "zzz")], "query_id string, term string")
    facts = search.corpus_facts(quotes)
    scores = {}
    for r in search.bm25(search.postings(quotes), asked, *facts).collect():
        scores.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["quote_id"]))
    for scan, cells, rows in ((2_000_000, 250_000, 1_000), (20, 100, 7)):
        for name, value in (("SCAN_WEIGHTS", scan), ("CELLS", cells), ("ROWS", rows)):
            monkeypatch.setattr(search, name, value)
        found = {}
        for r in search.best_quotes(quotes, search.document_counts(quotes), asked, *facts, 3).collect():
            found.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["quote_id"]))
        assert {q: sorted(x)[:3] for q, x in found.items()} == {q: sorted(x)[:3] for q, x in scores.items()}
        assert max(len(x) for x in found.values()) < len(texts)  # not all scores leave the tasks
    monkeypatch.setattr(search, "SCAN_TERMS", 2)
    near = {tuple(r) for r in search.fuzzy_terms(search.document_counts(quotes), asked).collect()}
    assert {t for q, t in near if q == "q0"} >= {r["term"] for r in asked.filter("query_id = 'q0'").collect()} & set(" ".join(texts).split())


def test_bounds_of_shared_members_never_cut(spark):
    """Bits bound what sets share from above, and bands of edit distances change no outcome."""
    rng = random.Random(3)
    sets = [rng.sample(range(3000), rng.randint(0, 400)) for _ in range(12)]
    rows = [(i, j, [*a], [*a[: len(a) // 2], *b] if i % 2 else [*b]) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    table = spark.createDataFrame([(i, j, a, sorted(set(b))) for i, j, a, b in rows], "i int, j int, a array<long>, b array<long>")
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    most = dedup.most_shared(F.size("a"), dedup.set_bits(hashed("a"), 4), dedup.set_bits(hashed("b"), 4))
    found = table.select("i", "j", "a", "b", most.alias("most")).collect()
    assert all(len(r["a"]) >= r["most"] >= len(set(r["a"]) & set(r["b"])) for r in found)
    assert any(r["most"] < len(r["a"]) for r in found) and all(r["most"] == len(r["a"]) for r in found if r["i"] == r["j"])
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    pairs = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    one, other = (dedup.edit_at_least(F.col("x"), F.col("y"), 0.5, bands) for bands in ((), (2, 8)))
    assert pairs.filter(one).count() > len(texts) and not pairs.filter(one != other).count()


def test_blocks_vote_as_pairs_do(spark, monkeypatch):
    """All pairs of blocks get the signals of a vote on pairs; texts that a walk by words shows to be near need no table of distances."""
    from quotegraph.operators import votes

    rng = random.Random(11)
    names = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 13))) for _ in range(40)]
    rows, base = [], []
    for _ in range(160):  # copies of few texts, changed by words and letters, between equal starts and ends
        base = [rng.choice(names) for _ in range(rng.randint(3, 40))] if rng.random() < 0.2 or not base else base
        words = [rng.choice(names) if rng.random() < rng.choice((0, 0.1, 0.3)) else w for w in base if rng.random() < 0.97]
        rows.append(" ".join(["one", "two", "three", "four", "five"][: rng.choice((0, 5, 5))] + words + ["six", "seven", "eight", "nine", "ten"][: rng.choice((0, 5))]))
    rows += [f"a start that all share {i:x} {i * 7:o} {i * 31:x}" for i in range(dedup.MOST_BLOCK + 1)] + ["", "short", "x" * 40, "only two" * 9]
    forms = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "quote_id string, form string").repartition(5)
    rare = F.array_distinct(F.filter(dedup.word_list(F.col("form")), lambda w: F.length(w) >= 9))
    pairs = dedup.block_pairs(forms.select("quote_id", F.explode(dedup.blocking_keys(F.col("form"))).alias("key")))
    for threshold in (0.82, 0.6):
        one, other = (sorted(map(tuple, x.collect())) for x in (votes.block_signals(forms, threshold), dedup.pair_signals(pairs, forms.withColumn("rare", rare), threshold)))
        assert one == other and len(one) > 1000
        assert {(r[2] | r[3], r[4]) for r in one} == {(False, False), (True, False), (True, True)}
    monkeypatch.setattr(votes, "edits_within", None)
    words = [rng.choice(names) for _ in range(300)]
    near = votes.Block([" ".join(w for k, w in enumerate(words) if k % 60 != i) + f" end{i}" * (i % 3) for i in range(12)])
    assert all(near.near(i, j, 0.82) for i in range(12) for j in range(12))


def test_edit_distances_of_bits_are_those_of_tables(spark):
    from quotegraph.operators import votes

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 90)))) for _ in range(24)]
    texts += [t[:20] + "xyz" + t[20:] for t in texts[:12]]
    pairs = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    for r in pairs.select("x", "y", F.levenshtein("x", "y").alias("d")).collect():
        assert [*votes.distances(r["x"], r["y"])][-1] == r["d"]
        assert all(votes.edits_within(r["x"], r["y"], most) == (r["d"] <= most) for most in (0, 2, 8, max(r["d"] - 1, 0), r["d"]))


def test_works_are_linked_in_whole_texts(spark, tmp_path):
    from quotegraph.rule_queries import QUERIES

    texts = [f"plain prose number {i} that names no work" for i in range(32)]
    texts[1] = "word " * 20000 + 'from the book "Deep Waters"'
    texts[2] = "what we found in a quiet title " + "word " * 20000
    texts[3], texts[5], texts[19] = None, None, "word " * 20000
    texts[27] = "as it stands in a quiet title, so it goes on"
    got = {(r["quote_id"], r["work"], r["match_type"]) for r in QUERIES["ext6_linked_works_whole"](spark, graph_tables(spark, tmp_path, texts)).collect()}
    known, new = ("A Quiet Title", "explicit_quotes_reused"), ("Another Known One", "explicit_quotes_new")
    named = ("A Quiet Title", "existing_work")
    assert got == {(1, "Deep Waters", "explicit_quotes_new"), (2, *named), (3, *known), (19, *known), (11, *new), (15, *named), (31, *named), (27, *named)}


def test_tokens_of_every_document_match_brute_force(spark, tmp_path):
    import unicodedata

    from quotegraph.rule_queries import QUERIES

    texts = ["plain, ascii text_1", "naïve café — «déjà»", "日本語。テスト", "a\u00a0b\u2003c\u3000d\u2028e", "Ⅷ ½ 😀!", "", None, "x\ny\t.z"]

    def count(t):
        n, inside = 0, False
        for c in t or "":
            word = c == "_" or unicodedata.category(c)[0] in "LN"
            n += (word and not inside) or not (word or c.isspace())
            inside = word
        return n

    got = {r["quote_id"]: r["tokens"] for r in QUERIES["txt20_tokens"](spark, graph_tables(spark, tmp_path, texts)).collect()}
    assert got == {i: count(t) for i, t in enumerate(texts)}


def test_registered_signatures_have_128_permutations(spark, tmp_path):
    import hashlib

    from quotegraph.rule_queries import QUERIES

    texts = ["the first of some texts", "another text stands here"]
    got = {r["quote_id"]: r["signature"] for r in QUERIES["sim8_minhash_signatures"](spark, graph_tables(spark, tmp_path, texts)).collect()}
    forms = spark.createDataFrame(list(enumerate(texts)), "quote_id long, form string")
    whole = {r[0]: r[1] for r in dedup.minhash_signatures(forms, 128).collect()}
    assert got == {i: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for i, x in whole.items()}


def test_ingest_dedup_misses_no_pair(spark):
    import difflib
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    mixed = []
    for _ in range(12):  # copies with 1 to 14 edited characters anywhere
        base = " ".join(word() for _ in range(rng.choice((4, 12, 30)))).ljust(20, "q")
        for edits in (0, 1, 2, 4, 7, 14):
            letters = list(base)
            for _ in range(edits):
                letters[rng.randrange(len(letters))] = rng.choice(["", "x", "yz"])
            mixed.append("".join(letters))
    spread = "alpha " * 2 + " ".join(word() for _ in range(25)) + " unquestionably omega end here now"
    mixed += [spread, spread.replace("alpha", "alpga", 1).replace("unquestionably", "unquestionebly").replace("now", "nov")]
    rows = list(enumerate(dict.fromkeys(mixed)))
    gone = {j for j, b in rows for i, a in rows if i < j and difflib.SequenceMatcher(None, b, a).ratio() >= 0.95}
    got = {r["quote_id"] for r in dedup.ingest_dedup(spark.createDataFrame(rows, "quote_id long, text string")).collect()}
    assert len(gone) > 20 and len(rows) - 1 in gone and got == {i for i, _ in rows} - gone

    middles = [" ".join(word() for _ in range(8)) for _ in range(520)]  # one opening and one ending for all
    texts = [f"it is said that whoever {m} shall never come back again" for m in middles]
    hot = list(enumerate([*texts, texts[7].replace(middles[7], "z" + middles[7][1:])]))
    got = {r["quote_id"] for r in dedup.ingest_dedup(spark.createDataFrame(hot, "quote_id long, text string")).collect()}
    assert got == set(range(520))


def test_each_pattern_runs_once_a_row(spark):
    """Plans hold each pattern once, however often its outcome is used."""
    rows = spark.createDataFrame([("a [1] text (Page 3)",)], "t string")
    for column, pattern, times in ((text.in_place_clean(F.col("t")), "citation needed", 1), (text.dedup_form(F.col("t")), "{2,}", 1), (extract.quoted_title(F.col("t")), "as quoted in", 2)):
        plan = rows.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(pattern) == times, pattern


def test_cleaning_matches_the_rules_one_by_one(spark):
    """The guards before two patterns never change what the patterns do."""
    rng, parts = random.Random(3), ["Read more", "see MORE", "Share", ".", ":", " ", "\n", "(", ")", "p. 12", "vol. 3", "chapter IV", "page", "word", "Kopy", "—", "&amp;", "[3]", "....", "“", "'", "\u00a0", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    now = F.col("t")
    for name, pattern, to in (("HTML_JUNK", text.HTML_JUNK, ""), ("WIKI_BRACKETS", text.WIKI_BRACKETS, ""), ("UI_JUNK", text.UI_JUNK, ""), ("SOURCE_METADATA", text.SOURCE_METADATA, ""), ("EXCESSIVE_PUNCT", text.EXCESSIVE_PUNCT, "…")):
        df = df.withColumn(name, now.rlike(pattern)).withColumn("_" + name, F.regexp_replace(now, pattern, to))
        now = F.col("_" + name)
    names = ["HTML_JUNK", "WIKI_BRACKETS", "UI_JUNK", "SOURCE_METADATA", "EXCESSIVE_PUNCT"]
    for r in df.withColumn("c", text.in_place_clean(F.col("t"))).collect():
        assert r["c"]["rules"] == [n for n in names if r[n]], r["t"]
        bare = re.sub(text.S + "+", " ", r["_EXCESSIVE_PUNCT"].replace("\u00a0", " "))
        bare = bare.strip(text.SPACES).lstrip(text.OPENING_MARKS).rstrip(text.CLOSING_MARKS).strip(text.SPACES)
        assert r["c"]["text"] == (r["t"] if r["c"]["confidence"] == 0 else bare), r["t"]


def test_forms_and_ratios_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé①ﬁ") for _ in range(rng.randrange(1, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 9))), " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(80)] + [(90, "", "x"), (91, "", "")]
    got = spark.createDataFrame(rows, "i long, a string, b string").select("i", "a", "b", text.nfkc(F.col("a")).alias("n"), score.sequence_ratio("a", "b").alias("r"), score.match_rank(F.col("a"), F.col("b"), F.lit(2.0)).alias("m")).collect()
    for r in got:
        assert r["n"] == unicodedata.normalize("NFKC", r["a"]) and r["r"] == difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        a, b = r["a"].lower(), r["b"].lower()
        ratio = min(len(a), len(b)) / max(len(a), len(b)) if max(len(a), len(b)) else 0.0
        prefix = len(os.path.commonprefix([a, b])) / len(a) if a else 0.0
        assert abs(r["m"] - (1.0 + 0.2 * ratio + 0.15 * prefix + 0.15 * difflib.SequenceMatcher(None, a, b).ratio())) < 1e-9


def test_a_stored_index_is_made_found_replaced_and_dropped(spark, tmp_path):
    quotes = spark.createDataFrame([(i, f"word{i % 7} and the other {'rare' if i == 5 else 'thing'}") for i in range(40)], "quote_id long, text string")
    index = search.StoredIndex(spark, str(tmp_path / "index"))
    assert not index.exists()
    index.create(quotes.limit(3))
    assert index.exists() and index.facts()[0] == 3
    index.create(quotes)
    assert index.facts()[0] == 3
    index.create(quotes, replace=True)
    assert index.facts()[0] == 40 and index.version() == "v000000001"
    asked = spark.createDataFrame([(1, "rare"), (1, "word5"), (2, "none")], "query_id long, term string")
    stored, direct = (sorted((r["query_id"], r["quote_id"], round(r["score"], 9)) for r in x.collect()) for x in (index.score(asked), search.bm25(search.postings(quotes), asked, *search.corpus_facts(quotes))))
    assert stored == direct and stored[0][:2] == (1, 5)
    index.drop()
    assert not index.exists()


def test_voice_queries_are_routed_searched_and_attributed(spark):
    quotes = spark.createDataFrame([(1, "To be or not to be, that is the question of this night", 7, "high_quality", None), (2, "Something else that is long enough to be shown here", 5, "review", None)], "quote_id long, text string, quality_score int, quality_bucket string, is_canonical boolean")
    said = spark.createDataFrame([("Hamlet", 1)], "person string, quote_id long")
    works = spark.createDataFrame([("Hamlet", 1)], "work string, quote_id long")
    asked = spark.createDataFrame([(1, "to be or not to be", "Ann"), (2, "quotes by the poet", None), (3, "ab", None), (4, "zzz qqq", None)], "query_id long, query string, speaker string")
    got = {r["query_id"]: r for r in conversation.answer_voice(asked, quotes, said, works).collect()}
    assert got[1]["response_text"] == '"To be or not to be, that is the question of this night"\n\n— William Shakespeare, from *Hamlet*\n\n*Personalized for Ann*'
    assert got[1]["audio_text"].startswith("To be") and got[2]["intent"] == "clarification" and got[2]["audio_text"] is None
    assert got[2]["response_text"].startswith("**Which poet") and got[3]["response_text"].startswith("**Query too short.**")
    assert got[4]["response_text"] == got[4]["audio_text"] == "I couldn't find a relevant quote for your question."


def test_votes_match_brute_force(spark):
    """Two signals of three, for all pairs of a few forms."""
    rng = random.Random(8)
    words = "alpha bravo charlie delta echo foxtrot golf hotel".split()
    forms = [(i, " ".join(rng.sample(words, rng.randrange(4, 9))), sorted(rng.sample(words, 3))) for i in range(14)]
    forms += [(20 + i, f.replace("o", "0", 1), r) for i, f, r in forms[:6]]
    table = spark.createDataFrame(forms, "quote_id long, form string, rare array<string>")
    pairs = spark.createDataFrame([(a[0], b[0]) for a in forms for b in forms if a[0] < b[0]], "a long, b long")
    own = {i: (f, set(f.split()), set(r)) for i, f, r in forms}

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    share = lambda a, b: len(a & b) / len(a | b)
    for r in dedup.pair_signals(pairs, table, 0.6).collect():
        (fa, wa, ra), (fb, wb, rb) = own[r["a"]], own[r["b"]]
        similar, rare, near = share(wa, wb) >= 0.6, share(ra, rb) >= 0.6, edit(fa, fb) >= 0.6
        assert r["duplicate"] == (sum((similar, rare, near and (similar or rare))) >= 2)
