"""Authors, works and page types found in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotegraph.functions.text import D, S, bind, collapse, strip, title_key, unwrap

# Words in a category and the role that they mean.
ROLES = {
    "physicists": "Scientist",
    "mathematicians": "Scientist",
    "biologists": "Scientist",
    "chemists": "Scientist",
    "astronomers": "Scientist",
    "scientists": "Scientist",
    "writers": "Author",
    "novelists": "Author",
    "poets": "Author",
    "playwrights": "Author",
    "painters": "Artist",
    "sculptors": "Artist",
    "architects": "Artist",
    "actors": "Actor",
    "actresses": "Actor",
    "directors": "Director",
    "musicians": "Musician",
    "singers": "Musician",
    "composers": "Musician",
    "politicians": "Politician",
    "presidents": "Politician",
    "monarchs": "Politician",
    "prime ministers": "Politician",
    "revolutionaries": "Activists",
    "philosophers": "Philosopher",
    "theologians": "Philosopher",
}
# Categories of people, and of works by someone.
PEOPLE = ("births", "deaths", "living people")
WORK_BY = r"(?iu)(?:films|novels|plays|books|speeches|essays) by (.+)"
# What an author or a work is not.
AUTHOR_BLACKLIST = (
    "unknown", "anonymous", "read more", "continue reading", "wikipedia", "wikiquote", "internet movie database", "imdb",
    "the new york times", "new york times", "the guardian", "bbc", "chapter", "page", "ibid", "op cit", "et al", "translated by",
    "edited by", "directed by", "youtube", "twitter", "facebook",
)
WORK_BLACKLIST = (
    "unknown", "anonymous", "read more", "continue reading", "wikipedia", "wikiquote", "internet movie database", "imdb",
    "the new york times", "new york times", "the guardian", "bbc", "youtube", "twitter", "facebook", "page", "chapter", "vol", "volume",
)
PREFIX_BLACKLIST = ("page ", "ch ", "chapter ", "vol ", "volume ", "http", "www", "read ", "from ")
# Phrases before a quoted title, in order of preference.
TITLE_PHRASES = ("from the book", "in the book", "from his book", "from her book", "as quoted in", "from the play", "from the poem", "from the essay")
# A trailing attribution, after a dash or in parentheses, and what such a text has.
ATTRIBUTION = rf"(?s)\A(.*?){S}+(?:[—–\-~]{S}*([A-Z][^\n]{{4,50}}?)|\({S}*([A-Z][^\n]{{4,50}}?){S}*\)){S}*\z"
ATTRIBUTION_MARK = rf"{S}[—–\-~(]"


def page_facts(title: Column, text: Column) -> Column:
    """``struct(entity_type, roles, real_author, categories)`` of a page by its categories."""
    categories = F.regexp_extract_all(text, F.lit(r"\[\[Category:([^\n]*?)\]\]"), F.lit(1))
    low = F.transform(categories, F.lower)
    by = F.filter(F.transform(categories, lambda c: F.regexp_extract(c, WORK_BY, 1)), lambda a: a != "")
    table = F.array(*[F.struct(F.lit(k).alias("word"), F.lit(v).alias("role")) for k, v in ROLES.items()])
    hits = F.filter(table, lambda r: F.exists(low, lambda c: c.contains(r["word"])))
    roles = F.array_sort(F.array_distinct(F.transform(hits, lambda r: r["role"])))
    person = F.exists(low, lambda c: c.contains(PEOPLE[0]) | c.contains(PEOPLE[1]) | c.contains(PEOPLE[2]))
    kind = F.when(F.size(by) > 0, "Work").when((F.size(roles) > 0) | person, "Person").otherwise("Source")
    author = F.when(F.size(by) > 0, strip(F.substring_index(F.element_at(by, -1), "|", 1)))
    return F.struct(kind.alias("entity_type"), roles.alias("roles"), author.alias("real_author"), categories.alias("categories"))


def _reject(name: Column, digits: int, blacklist: tuple[str, ...]) -> Column:
    low = F.lower(name)
    reason = F.when(F.length(name) < 4, "too short").when(F.length(name) > 60, "too long")
    reason = reason.when(low.contains("http") | low.contains("www.") | low.contains(".com"), "url")
    reason = reason.when(F.regexp_count(name, F.lit(D)) >= digits, "digits").when(low.isin(*blacklist), "blacklisted")
    for prefix in PREFIX_BLACKLIST:
        reason = reason.when(low.startswith(prefix), "blacklisted prefix")
    return reason.when(~name.rlike(r"\p{Lu}"), "no capital")


def author_reject_reason(name: Column) -> Column:
    """Why a candidate is no author; null if it may be one."""
    return bind(collapse(name), lambda n: _reject(n, 4, AUTHOR_BLACKLIST))


def work_reject_reason(title: Column) -> Column:
    """Why a candidate is no work; null if it may be one."""
    return bind(strip(title), lambda t: _reject(t, 8, WORK_BLACKLIST))


def extract_author(text: Column) -> Column:
    """``struct(quote, author, confidence, pattern)`` of a trailing attribution, or null."""

    def parts(bare: Column) -> Column:
        # the pattern holds one name, so a text without either has no match
        found = F.struct(*[F.regexp_extract(bare, ATTRIBUTION, i).alias(n) for i, n in ((1, "quote"), (2, "dash"), (3, "parens"))])
        return F.when(bare.rlike(ATTRIBUTION_MARK), bind(found, named))

    def named(x: Column) -> Column:
        name = F.regexp_replace(strip(F.when(x["dash"] != "", x["dash"]).otherwise(x["parens"])), r"[.,;:]\z", "")
        return bind(strip(name), lambda author: checked(x, author))

    def checked(x: Column, author: Column) -> Column:
        words = F.filter(F.split(author, rf"{S}+"), lambda w: w != "")
        sure = bind(words, lambda w: F.size(w).between(2, 3) & F.forall(w, lambda one: ~one.rlike(r"\A\p{L}+\z") | one.rlike(r"\A\p{Lu}")))
        found = F.struct(unwrap(x["quote"]).alias("quote"), author.alias("author"), F.when(sure, 0.98).otherwise(0.90).alias("confidence"), F.when(x["dash"] != "", "dash").otherwise("parens").alias("pattern"))
        return F.when((author != "") & author_reject_reason(author).isNull(), found)

    return bind(strip(text), parts)


def quoted_title(text: Column) -> Column:
    """The first acceptable title in quote marks after one of the phrases, by the phrases' order; or null.

    Texts without any phrase before a quote mark are told by one pattern.
    """

    def title(t: Column, phrase: str) -> Column:
        found = strip(F.regexp_extract(t, rf"(?iu)\b{phrase}{S}+[\"“‘]([A-Z][^”’\"]{{3,60}}?)[\"”’]", 1))
        return bind(found, lambda x: F.when((x != "") & work_reject_reason(x).isNull(), x))

    some = text.rlike(rf"(?iu)(?:{'|'.join(TITLE_PHRASES)}){S}+[\"“‘]")
    return F.when(some, bind(text, lambda t: F.coalesce(*[title(t, phrase) for phrase in TITLE_PHRASES])))


__all__ = ["author_reject_reason", "extract_author", "page_facts", "quoted_title", "title_key", "work_reject_reason"]
