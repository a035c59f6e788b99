"""Text cleaning as Column expressions. Spaces, digits and letters are Unicode's."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space, digits and word characters as the patterns below mean them (Java's own classes are ASCII).
S = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NOT_S = S.replace("[", "[^", 1)
D, W = r"\p{Nd}", r"[\p{L}\p{N}_]"
#: The characters of S, to trim by.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(S, c))

# Characters that may wrap a quote.
OPENING_MARKS, CLOSING_MARKS = "\"'“‘", "\"'”’"
# Punctuation that normal forms lose.
ASCII_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
QUOTE_PUNCTUATION = "“”‘’«»…"
# Starts of lines that are no quotes.
METADATA_STARTS = ("[[Category:", "{{", "File:", "Image:", "==", "See also", "External links", "References")
# Phrases of the pages' own texts that the rule UI_JUNK looks for at a text's end and at its start.
UI_ENDS = "Read more|See more|Show more|Continue reading|Share|Copy|Tweet|Pin it"
UI_STARTS = "Read more|See more|Show more"
# Patterns of the in-place cleaning rules, in the order in which they run.
HTML_JUNK = rf"&[a-z]+;|&#{D}+;|</?{W}+[^>]*>|^{S}*\*+{S}*|^{S}*={S}*"
WIKI_BRACKETS = rf"(?iu)\[{D}+\]|\[(?:citation needed|note {D}+|source)\]"
UI_JUNK = rf"(?iu)(?:\b(?:{UI_ENDS})\b(?:[.:]|{S})*)\z|^(?:\b(?:{UI_STARTS})\b(?:[.:]|{S})*)"
SOURCE_METADATA = (
    rf"(?iu)(?:[(\[\-—]{S}*)?(?:(?:p\.|pp\.|page|pages){S}*{D}+(?:-{D}+)?|(?:vol\.|volume){S}*{D}+"
    rf"|(?:ch\.|chapter){S}*{W}+|(?:issue|edition){S}*{D}+)(?:{S}*[)\]])?{S}*\z"
)
EXCESSIVE_PUNCT = r"\.{4,}"
# Page markup, and what is left of it.
BOLD_MARKS, LINK, TEMPLATE, TAG, BRACKETS = "'{2,5}", r"\[\[(?=[^\]])(?:[^\]]*\|)?([^\]|]*)\]\]", r"\{\{[^}]+\}\}", "<[^>]+>", r"\[\[|\]\]|\{\{|\}\}"
# Patterns of the quality filter, at the start of a text.
FILTER_STARTS = r"(?iu)^(?:\[.*\](?:\z|\n\z)|File:|Image:|Retrieved|Archived|\{\{|\|)"
# Patterns that mark a text as a candidate for cleaning; each is tried on a text of one line.
DIRTY = ("(?i).*(read more|see more|show more).*", r"(?i).*(page |p\.|pp\.|vol\.|chapter ).*", r".*\[\d+\].*", ".*&[a-zA-Z]+;.*", ".*<[^>]+>.*")


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces are left as they stand."""
    return F.trim(F.regexp_replace(c, rf"{S}{{2,}}|{S[:-1]}&&[^ ]]", " "))


def unwrap(c: Column, opening: str = OPENING_MARKS, closing: str = CLOSING_MARKS) -> Column:
    """Without the quote marks around a stripped text."""
    return strip(F.rtrim(F.ltrim(strip(c), F.lit(opening)), F.lit(closing)))


def without_marks(c: Column, marks: str) -> Column:
    """``c`` without the characters ``marks``."""
    return F.regexp_replace(c, "[" + "".join("\\" + m if m.isascii() else m for m in marks) + "]+", "")


def full_match(c: Column, pattern: str) -> Column:
    """Whether a pattern matches the whole text; a dot doesn't match a line's end."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return c.rlike(rf"{flags}\A(?:{pattern.removeprefix('(?i)')})\z")


def wiki_text(c: Column) -> Column:
    """Page markup: bold and italic marks, links (their last part stays), templates, tags, white space."""
    c = F.regexp_replace(F.regexp_replace(c, BOLD_MARKS, ""), LINK, "$1")
    return collapse(F.regexp_replace(F.regexp_replace(c, TEMPLATE, ""), TAG, ""))


def quote_lines(text: Column) -> Column:
    """The quotes among a page's lines, in order."""

    def one(line: Column) -> Column:
        bare = strip(F.regexp_replace(line, r"^[*: ]+", ""))
        meta = F.lit(False)
        for start in METADATA_STARTS:
            meta = meta | bare.startswith(start)
        return F.when(strip(line).rlike('^[*":]') & (F.length(bare) >= 20) & ~meta, wiki_text(bare))

    found = F.transform(F.split(text, "\n"), lambda line: one(strip(line)))
    return F.filter(found, lambda q: q.isNotNull() & (F.length(q) >= 20))


def markup_remnants(c: Column) -> Column:
    """Brackets and braces of links and templates, bold and italic marks, tags; what they hold stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, BRACKETS, ""), BOLD_MARKS, ""), TAG, "")


@F.pandas_udf(StringType())
def _unescape(c: pd.Series) -> pd.Series:
    return c.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def accent_key(c: pd.Series) -> pd.Series:
    """A name's key: lower case, accents dropped, white space collapsed."""

    def key(name: str | None) -> str:
        marks = unicodedata.normalize("NFD", (name or "").lower())
        return " ".join("".join(x for x in marks if unicodedata.category(x) != "Mn").split())

    return c.map(key)


def decode_entities(c: Column) -> Column:
    """HTML entities, named and numeric."""
    return _unescape(c)


def nfkc(c: Column) -> Column:
    """Unicode's NFKC form. Plain ASCII is its own form, but a UDF runs over every row it is given."""
    return _nfkc(c)


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, rf"https?://{NOT_S}+|www\.{NOT_S}+", "")


def remove_footnotes(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?iu)\[{D}+\]|\[citation needed\]|\[note {D}+\]", "")


def plain_marks(c: Column, extended: bool = False) -> Column:
    """Guillemets as straight quotes; with ``extended`` curly quotes too."""
    more = ("“”‘’", "\"\"''") if extended else ("", "")
    return F.translate(c, "«»‹›" + more[0], "\"\"''" + more[1])


def tidy_spaces(c: Column) -> Column:
    """White space collapsed, none before and one after ``.,!?;:``."""
    c = F.regexp_replace(F.regexp_replace(c, rf"{S}+", " "), r" +([.,!?;:])", "$1")
    return F.trim(F.regexp_replace(c, r"([.,!?;:]) +", "$1 "))


def full_clean(c: Column, decode: bool = True) -> Column:
    """The ingest chain without its language filter and dedup; null if under 10 characters.

    ``decode=False`` leaves entities and compatibility forms alone, and stays in the JVM.
    """
    out = markup_remnants(c)
    out = remove_footnotes(remove_urls(decode_entities(out) if decode else out))
    out = tidy_spaces(plain_marks(nfkc(out) if decode else out))
    return F.when(F.length(strip(c)) >= 10, out)


def _ends_in_ui(c: Column) -> Column:
    """Whether UI_JUNK can match: a phrase before the marks and spaces at the end, or at the start."""
    tail = F.substring(F.rtrim(c, F.lit(SPACES + ".:")), -16, 16)
    return tail.rlike(rf"(?iu)(?:{UI_ENDS})\z") | F.substring(c, 1, 16).rlike(rf"(?iu)^(?:{UI_STARTS})")


def _ends_in_source(c: Column) -> Column:
    """Whether SOURCE_METADATA can match: it ends in a word's character or a bracket."""
    return F.substring(F.rtrim(c, F.lit(SPACES)), -1, 1).rlike(rf"{W}|[)\]]")


def in_place_clean(c: Column) -> Column:
    """``struct(text, rules, confidence, needs_review)`` of the rule-based cleaning. Each rule's pattern runs once, and only where it can match."""
    always = lambda t: F.lit(True)
    steps = (("HTML_JUNK", HTML_JUNK, "", always), ("WIKI_BRACKETS", WIKI_BRACKETS, "", always), ("UI_JUNK", UI_JUNK, "", _ends_in_ui), ("SOURCE_METADATA", SOURCE_METADATA, "", _ends_in_source), ("EXCESSIVE_PUNCT", EXCESSIVE_PUNCT, "…", always))

    def run(at: int, now: Column, fired: Column) -> Column:
        if at == len(steps):
            return bind(unwrap(F.regexp_replace(F.translate(now, " ", " "), rf"{S}{{2,}}|{S[:-1]}&&[^ ]]", " ")), lambda out: verdict(out, fired))
        name, pattern, to, can = steps[at]
        # a pattern that matches takes something away, so a rule fires where the text changes
        return bind(F.when(can(now), F.regexp_replace(now, pattern, to)).otherwise(now), lambda new: run(at + 1, new, F.when(new != now, F.concat(fired, F.array(F.lit(name)))).otherwise(fired)))

    def verdict(now: Column, fired: Column) -> Column:
        return bind(F.struct(strip(c).alias("old"), fired.alias("fired")), lambda x: judged(now, x["old"], x["fired"]))

    def judged(now: Column, old: Column, fired: Column) -> Column:
        new_length, same = F.length(now), (old == now) & (F.size(fired) == 0)
        removed = 1.0 - new_length / F.greatest(F.lit(1), F.length(old))
        confidence = F.when(same, 0.0).when(new_length < 10, 0.1).when(removed > 0.30, 0.5).when(F.array_contains(fired, "UI_JUNK") | F.array_contains(fired, "SOURCE_METADATA"), 0.95).otherwise(1.0)
        return F.struct(F.when(same, c).otherwise(now).alias("text"), fired.alias("rules"), confidence.alias("confidence"), (~same & ((new_length < 10) | (removed > 0.30))).alias("needs_review"))

    none = F.struct(F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("rules"), F.lit(1.0).alias("confidence"), F.lit(False).alias("needs_review"))
    return F.when(c.isNull(), none).otherwise(run(0, c, F.array().cast("array<string>")))


def dirty_candidate(c: Column) -> Column:
    found = F.lit(False)
    for pattern in DIRTY:
        found = found | full_match(c, pattern)
    return found


def dedup_form(c: Column) -> Column:
    """The normal form of the graph's dedup: unwrapped, lower case, no punctuation, white space collapsed."""
    return collapse(without_marks(F.lower(unwrap(F.coalesce(c, F.lit("")))), ASCII_PUNCTUATION + QUOTE_PUNCTUATION))


def layered_form(c: Column, compose: bool = True) -> Column:
    """The normal form of the layered dedup: NFKC, a trailing attribution dropped, unwrapped, lower case, no ASCII punctuation."""
    text = nfkc(c) if compose else c
    text = strip(F.regexp_replace(text, rf"{S}*[—–\-~]{S}*[A-Z][^\n]{{0,60}}(?:\z|(?=\n\z))", ""))
    text = unwrap(text, OPENING_MARKS + "«‹", CLOSING_MARKS + "»›")
    return collapse(without_marks(F.lower(text), ASCII_PUNCTUATION))


def person_key(c: Column) -> Column:
    """A person's name as a key: lower case, word characters, white space, hyphens and apostrophes."""
    return collapse(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s\xa0\-']", ""))


def title_key(c: Column) -> Column:
    """A work's title as a key: lower case, word characters and white space."""
    return collapse(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s\xa0]", ""))


def passes_filter(c: Column, least: int = 20, most: int = 500) -> Column:
    """The quality predicate: length, no url, no metadata start, half letters, three words, few brackets."""
    n = F.length(c)
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    words = F.size(F.filter(F.split(c, rf"{S}+"), lambda w: w != ""))
    url = c.contains("http://") | c.contains("https://") | c.contains("www.")
    return n.between(least, most) & ~url & ~c.rlike(FILTER_STARTS) & (letters >= n * 0.5) & (words >= 3) & (F.regexp_count(c, F.lit(r"[{}\[\]|<>]")) <= 5)


def fast_ingest_text(c: Column) -> Column:
    """The stripped text, or null under 15 characters."""
    return F.when(F.length(strip(c)) >= 15, strip(c))


def tokens(c: Column) -> Column:
    """Words and punctuation marks, without a model."""
    return F.regexp_extract_all(c, F.lit(rf"({W}+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x85])"), F.lit(1))


def sentences(c: Column) -> Column:
    """Stretches that end with ``.``, ``!`` or ``?``, stripped."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"([^.!?]+[.!?]*)"), F.lit(1)), strip), lambda s: s != "")


def processed(c: Column) -> Column:
    """``struct(normalised, tokens, lemmas, sentences, sentence_count)`` of a text, without a model: a word is its own lemma.

    The normalised text has the lower-case words, one space between them; punctuation is left out.
    """

    def parts(all_tokens: Column) -> Column:
        words = F.filter(all_tokens, lambda t: t.rlike(rf"^{W}"))
        return bind(words, lambda lemmas: F.struct(F.array_join(F.transform(lemmas, lambda w: F.lower(w)), " ").alias("normalised"), all_tokens.alias("tokens"), lemmas.alias("lemmas")))

    return bind(F.struct(bind(tokens(c), parts).alias("t"), sentences(c).alias("s")), lambda x: F.struct(x["t"]["normalised"].alias("normalised"), x["t"]["tokens"].alias("tokens"), x["t"]["lemmas"].alias("lemmas"), x["s"].alias("sentences"), F.size(x["s"]).alias("sentence_count")))
