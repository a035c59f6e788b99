"""URL filters: rules, and a model of words in host and path.

Host names and path parts are split into words by Viterbi over the unigrams of all pages' texts.
Multinomial naive Bayes over the words of host and path gives the verdict where no rule fits. No
url is labelled, and the rules teach nothing: what the model learns from is what the urls lead to.
A page is poor if its own text is thin, is little beside its markup, or keeps repeating few words
(:func:`page_facts`); words that stand in urls of poor pages more often than in others speak for
blocking. Labelled urls, where a user has some, count beside the pages.

Words, counts and weights are tables that are joined, so no number of words is left out and
nothing but sums reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import inf, log

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegraph.plans.shared import materialize

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A page is poor with fewer words, with a smaller share of its characters in words, or with a smaller share of distinct words in its first LOOKED.
THIN_WORDS, LEAST_TEXT, LEAST_DISTINCT, LOOKED = 60, 0.25, 0.2, 1000
#: Smoothing of word counts; what an unknown word costs at least and for each letter, in nats, beyond a word seen once.
ALPHA, UNKNOWN = 0.5, 2.3
#: Runs of letters and digits whose weights may be broadcast, some 60 bytes each.
BROADCAST_RUNS = 300_000
#: Words that a task counts before it emits them.
TALLY_WORDS = 200_000
_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_ASCII_WORD, _WORD = re.compile("[a-z]+"), regex.compile(r"[\p{L}\p{M}]+")
_RUNS = r"([\p{L}\p{M}]+|\p{N}+)"
#: Log odds are added as whole numbers of this unit, so sums don't depend on the order.
_UNIT = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are longer and win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def page_words(html: str) -> list[str]:
    """The lower-case words of a page's own text: scripts, styles and tags left out."""
    text = _TAGS.sub(" ", html).lower()
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def is_poor(html: str, words: list[str]) -> bool:
    """Whether a page is poor; its words are given."""
    looked = words[:LOOKED]
    return len(words) < THIN_WORDS or sum(map(len, words)) < LEAST_TEXT * len(html) or len(set(looked)) < LEAST_DISTINCT * len(looked)


def page_facts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(page_id, url, poor)`` of each of ``pages``, poor null without html, and ``(word, n)`` of all their words. Pages are walked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def tally(kind: pa.DataType) -> pa.RecordBatch:
            n = len(seen)
            out = pa.RecordBatch.from_pydict({"page_id": pa.nulls(n, kind), "url": pa.nulls(n, pa.string()), "poor": pa.nulls(n, pa.bool_()), "word": pa.array(seen, pa.string()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        kind = None
        for b in batches:
            kind, poor = b.column("page_id").type, []
            for html in b.column("html").to_pylist():
                words = page_words(html or "")
                poor.append(None if html is None else is_poor(html, words))
                for word in words:
                    seen[word] = seen.get(word, 0) + 1
                if len(seen) > TALLY_WORDS:
                    yield tally(kind)
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "poor": pa.array(poor, pa.bool_()), "word": pa.nulls(len(b), pa.string()), "n": pa.nulls(len(b), pa.int64())})
        if seen:
            yield tally(kind)

    kind = pages.schema["page_id"].dataType.simpleString()
    both = materialize(pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, poor boolean, word string, n long"), "url-pages")
    return both.filter("word IS NULL").select("page_id", "url", "poor"), both.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))


def url_runs(host: Column, path: Column) -> Column:
    """Runs of letters or of digits of host and path, percent-decoded and in lower case, as (mark, run): the mark says where they stand."""

    def runs(part: Column, mark: str) -> Column:
        plain = F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)
        return F.transform(F.regexp_extract_all(F.lower(plain), F.lit(_RUNS), F.lit(1)), lambda run: F.struct(F.lit(mark).alias("mark"), run.alias("run")))

    return F.concat(runs(host, "h:"), runs(path, "p:"))


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a run of letters, by unigram Viterbi; of equally likely ones that with the longer last word.

    ``counts`` has the words that stand in ``name``, ``total`` is one more than all words' counts. An
    unknown word of any length may stand anywhere and costs more the longer it is.
    """
    floor = log(total)
    cost = {w: floor - log(n) for w, n in counts.items()}
    lengths = sorted({len(w) for w in cost}, reverse=True)
    best, back = [0.0], [0]
    start, least = 0, 0.0  # where the cheapest unknown word that ends here begins, and its cost but for its end
    for end in range(1, len(name) + 1):
        low, at = floor + UNKNOWN * (end + 1) + least, start
        for n in lengths:
            if n <= end and (own := cost.get(name[end - n : end], inf)) < inf and (best[end - n] + own, end - n) < (low, at):
                low, at = best[end - n] + own, end - n
        best.append(low)
        back.append(at)
        if low - UNKNOWN * end < least:
            start, least = end, low - UNKNOWN * end
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(run, parts)``: the words of each distinct run of ``names`` (run), by ``lexicon`` (word, n), a written table of any size."""
    total, longest = lexicon.agg(F.sum("n"), F.max(F.length("word"))).first()
    total, longest = (total or 0) + 1, longest or 0

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in b.column("run").to_pylist():
                for at in range(0, len(run), 1 << 12):  # a long run comes in parts; a stretch may come twice
                    words = list({run[i : i + n] for i in range(at, min(len(run), at + (1 << 12))) for n in range(1, min(longest, len(run) - i) + 1)})
                    yield pa.RecordBatch.from_pydict({"run": pa.array([run] * len(words), pa.string()), "word": pa.array(words, pa.string())})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [segment(run, {x["word"]: x["n"] for x in own or ()}, total) for run, own in zip(b.column("run").to_pylist(), b.column("own").to_pylist())]
            yield pa.RecordBatch.from_pydict({"run": b.column("run"), "parts": pa.array(parts, pa.list_(pa.string()))})

    found = names.mapInArrow(stretches, "run string, word string").join(lexicon, "word").groupBy("run").agg(F.collect_set(F.struct("word", "n")).alias("own"))
    return materialize(names.join(found, "run", "left").select("run", "own").mapInArrow(split, "run string, parts array<string>"), "url-parts")


def word_odds(taught: DataFrame, worded: DataFrame) -> tuple[DataFrame, int, int]:
    """``(token, odds)`` in _UNIT for each token of ``taught`` (_id, bad), with the odds of a new token and to begin with.

    ``worded`` has (_id, tokens). Odds are of block against allow.
    """
    of = lambda bad: F.sum(F.when(F.col("bad") == F.lit(bad), F.col("n")).otherwise(0))
    seen = taught.join(worded, "_id").select("bad", F.explode("tokens").alias("token")).groupBy("token", "bad").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(seen.groupBy("token").agg(of(True).alias("block"), of(False).alias("allow")), "url-counts")
    many, block, allow = counts.agg(F.count(F.lit(1)), F.sum("block"), F.sum("allow")).first()
    mass = {"block": (block or 0) + ALPHA * (many + 1), "allow": (allow or 0) + ALPHA * (many + 1)}
    weight = F.log((F.col("block") + ALPHA) / mass["block"]) - F.log((F.col("allow") + ALPHA) / mass["allow"])
    urls = dict(taught.groupBy("bad").agg(F.count(F.lit(1))).collect())  # two rows
    prior = log((urls.get(True, 0) + 1) / (urls.get(False, 0) + 1))
    return counts.select("token", F.round(weight * _UNIT).cast("long").alias("odds")), round(log(mass["allow"] / mass["block"]) * _UNIT), round(prior * _UNIT)


def judge(pages: DataFrame, rules=RULES, examples: DataFrame | None = None, learn: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_chance, words and poor of every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has empty host and path, no words, and the verdict of the
    prior. ``examples`` (url, verdict) are labelled urls to learn from beside the pages; ``learn``
    says, by page_id, which pages are learnt from (all that have html). Other columns are ignored;
    repeated rows give repeated results; an empty table gives an empty result. At 0.5 the verdict
    is allow. Ids may be of any type.
    """
    facts, counts = page_facts(pages)
    lexicon = materialize(counts, "url-lexicon")
    bad = F.when(F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)), F.col("poor"))
    rows = facts.select("page_id", "url", "poor", bad.alias("bad"), F.lit(True).alias("asked"))
    if examples is not None:
        rows = rows.unionByName(examples.filter("verdict IN ('block', 'allow')").select("url", (F.col("verdict") == "block").alias("bad"), F.lit(False).alias("asked")), allowMissingColumns=True)
    host, path = host_and_path(F.col("url"))
    rows = rows.select("*", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_id"))
    rows = materialize(rows.withColumn("_runs", url_runs(F.col("host"), F.col("path"))), "url-rows")

    placed = rows.select("_id", F.posexplode("_runs").alias("i", "_x")).select("_id", "i", "_x.mark", "_x.run")
    distinct = materialize(placed.select("mark", "run").distinct(), "url-runs")
    parts = segmented(materialize(distinct.select("run").filter(~F.col("run").rlike(r"^\p{N}")).distinct(), "url-names"), lexicon)
    tokens = F.transform(F.coalesce("parts", F.array(F.lit("#"))), lambda w: F.concat("mark", w))
    known = materialize(distinct.join(parts, "run", "left").select("mark", "run", tokens.alias("tokens")), "url-tokens")
    known = F.broadcast(known) if known.count() <= BROADCAST_RUNS else known
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "tokens"))), lambda x: x["tokens"]))
    worded = materialize(placed.join(known, ["mark", "run"]).groupBy("_id").agg(in_order.alias("tokens")), "url-worded")

    odds, new, prior = word_odds(rows.filter("bad IS NOT NULL").select("_id", "bad"), worded)
    odds = materialize(odds, "url-odds")
    side = F.broadcast(odds) if odds.count() <= BROADCAST_RUNS else odds
    weighed = worded.select("_id", F.explode("tokens").alias("token")).join(side, "token", "left").groupBy("_id").agg(F.sum(F.coalesce("odds", F.lit(new))).alias("_sum"))
    chance = 1 / (1 + F.exp(-(F.coalesce("_sum", F.lit(0)) + prior) / float(_UNIT)))
    found = rows.filter("asked").join(worded, "_id", "left").join(weighed, "_id", "left").withColumn("block_chance", chance)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("block_chance") > 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "block_chance", F.coalesce("tokens", F.array().cast("array<string>")).alias("words"), "poor")
