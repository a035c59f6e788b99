"""Dialogue rules: routing, intents, entities and attribution, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotegraph.functions.text import S, collapse, strip

# Terms that need a name, in the order in which they are looked for.
AMBIGUOUS = (
    "the prophet", "a prophet", "the philosopher", "a philosopher", "the poet", "a poet", "the writer", "a writer",
    "the author", "an author", "the president", "a president", "the king", "a king", "the queen", "a queen",
)
# Beginnings of quotes, and of questions.
QUOTE_STARTS = ("to be", "i think", "the only", "life is", "love is", "all that", "it is", "we are", "you are", "i am")
QUESTION_STARTS = ("who", "what", "where", "when", "why", "how", "find", "show", "give")
# Patterns of intents, in the order in which they are tried.
INTENTS = (
    ("quote_attribution", (r"who (said|wrote|authored|spoke)", r"who('s| is) the author", r"author of", r"who quoted", r"source of (the )?quote")),
    ("find_by_author", (r"quotes? (by|from) ([A-Z][a-z]+ ?)+", r"([A-Z][a-z]+ ?)+ quotes?", r"show me .+ quotes?", r"find quotes? (by|from)")),
    ("find_by_work", (r"quotes? from (.+)", r"in (the )?(book|movie|play|speech)", r"from (the )?(book|movie|play|speech)")),
    ("random_quote", (r"random quote", r"surprise me", r"any quote", r"give me (a )?quote")),
    ("quote_recommendation", (r"quotes? about", r"find quotes? (on|regarding)", r"recommend .+ quotes?", r"quotes? related to")),
)
# Works and their authors, in the order in which parts of names are looked for.
WORK_AUTHORS = {
    "hamlet": "William Shakespeare",
    "macbeth": "William Shakespeare",
    "romeo and juliet": "William Shakespeare",
    "othello": "William Shakespeare",
    "king lear": "William Shakespeare",
    "the tempest": "William Shakespeare",
    "a midsummer night's dream": "William Shakespeare",
    "julius caesar": "William Shakespeare",
    "merchant of venice": "William Shakespeare",
    "twelfth night": "William Shakespeare",
    "the prophet": "Kahlil Gibran",
    "the bible": "Various Authors (Biblical Scripture)",
    "the quran": "Islamic Scripture",
    "the koran": "Islamic Scripture",
    "the odyssey": "Homer",
    "the iliad": "Homer",
    "divine comedy": "Dante Alighieri",
    "paradise lost": "John Milton",
    "the republic": "Plato",
    "meditations": "Marcus Aurelius",
    "the art of war": "Sun Tzu",
    "thus spoke zarathustra": "Friedrich Nietzsche",
    "beyond good and evil": "Friedrich Nietzsche",
    "the prince": "Niccolò Machiavelli",
    "walden": "Henry David Thoreau",
    "leaves of grass": "Walt Whitman",
    "the waste land": "T.S. Eliot",
    "pride and prejudice": "Jane Austen",
    "1984": "George Orwell",
    "animal farm": "George Orwell",
    "brave new world": "Aldous Huxley",
    "fahrenheit 451": "Ray Bradbury",
    "to kill a mockingbird": "Harper Lee",
    "the great gatsby": "F. Scott Fitzgerald",
    "moby dick": "Herman Melville",
    "the catcher in the rye": "J.D. Salinger",
}
# First names that make an author certain, and what is known of some works.
FIRST_NAMES = ("william", "albert", "mark", "oscar", "friedrich")
WORK_CONTEXT = {"hamlet": "Act III, Scene I", "macbeth": "Tragedy", "romeo and juliet": "Tragedy", "the prophet": "Philosophical Poetry", "the odyssey": "Epic Poem", "the iliad": "Epic Poem"}
# Patterns of a spoken request for an author, and words that are no author.
AUTHOR_REQUESTS = (
    r"(?iu)^\s*(?:quotes?\s+)?by\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3})",
    r"(?iu)^\s*(?:find\s+(?:me\s+)?a\s+quote\s+)?from\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3})",
    r"(?iu)^\s*(?:what\s+did\s+)([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3})\s+say",
    r"(?iu)^\s*show\s+me\s+quotes?\s+(?:by|from)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3})",
)
NO_AUTHOR = ("the", "a", "an", "this", "that", "my", "your", "me")


def ambiguous_term(text: Column) -> Column:
    low = strip(F.lower(text))
    return F.coalesce(*[F.when(low.contains(term), F.lit(term)) for term in AMBIGUOUS])


def route(text: Column) -> Column:
    """clarification for an ambiguous or too short text, else autocomplete."""
    short = F.length(strip(F.lower(text))) < 3
    return F.when(ambiguous_term(text).isNotNull() | short, "clarification").otherwise("autocomplete")


def intent(text: Column) -> Column:
    """The intent of an utterance; completion is tried first."""
    bare = strip(text)
    low = F.lower(bare)
    starts = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.startswith(w))
    words = F.size(F.filter(F.split(bare, rf"{S}+"), lambda w: w != ""))
    completes = bare.rlike("[\"']") | starts(QUOTE_STARTS) | bare.contains("...") | bare.endswith("…") | ((words <= 10) & ~starts(QUESTION_STARTS))
    out = F.when(bare == "", "general_query").when(completes, "quote_completion")
    for name, patterns in INTENTS:
        out = out.when(bare.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), name)
    return out.otherwise("general_query")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def entity(text: Column) -> Column:
    """What an utterance asks for, by its intent: a quote, author, work or topic; null if none."""
    bare = strip(text)
    kind = intent(text)
    quote = F.coalesce(_group(bare, r"[\"'](.+?)[\"']"), strip(_group(bare, r"(?iu)who (?:said|wrote) (.+)")))
    author = F.coalesce(_group(bare, r"(?:by|from) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), _group(bare, r"([A-Z][a-z]+(?: [A-Z][a-z]+)+)"))
    partial = strip(F.translate(F.regexp_replace(F.regexp_replace(bare, r"^[\"']+|[\"']+\z", ""), r"\.\.\.", ""), "…", ""))
    return (
        F.when(kind == "quote_completion", partial)
        .when(kind == "quote_attribution", quote)
        .when(kind == "find_by_author", author)
        .when(kind == "find_by_work", strip(_group(bare, r"(?iu)from (?:the )?(.+)")))
        .when(kind == "quote_recommendation", strip(_group(bare, r"(?iu)about (.+)")))
        .when((kind == "general_query") & (bare != ""), bare)
    )


def requested_author(text: Column) -> Column:
    """The author whom a spoken request begins with, or null."""
    found = []
    for pattern in AUTHOR_REQUESTS:
        name = strip(F.regexp_extract(text, pattern, 1))
        found.append(F.when((F.length(name) > 2) & ~F.lower(name).isin(*NO_AUTHOR), name))
    return F.coalesce(*found)


def mapped_author(author: Column, work: Column) -> Column:
    """``struct(author, confidence)``: the author behind a work's or character's name."""
    a, w = F.lower(F.coalesce(author, F.lit(""))), F.lower(F.coalesce(work, F.lit("")))
    table = F.array(*[F.struct(F.lit(k).alias("work"), F.lit(v).alias("author")) for k, v in WORK_AUTHORS.items()])
    pick = lambda test: F.try_element_at(F.transform(F.filter(table, test), lambda r: r["author"]), F.lit(1))
    mapped = F.coalesce(pick(lambda r: r["work"] == a), pick(lambda r: r["work"] == w), pick(lambda r: a.contains(r["work"]) | w.contains(r["work"])))
    named = F.exists(F.array(*map(F.lit, FIRST_NAMES)), lambda n: a.contains(n))
    confidence = F.when(mapped.isNotNull() | named, "high").when((a != "") & (author != "Unknown"), "medium").otherwise("low")
    return F.struct(F.coalesce(mapped, F.when(a != "", author), F.lit("Unknown")).alias("author"), confidence.alias("confidence"))


def source_info(work: Column) -> Column:
    """The work with what is known of it."""
    low = F.lower(work)
    out = F.when(work.isNull() | (work == "") | (work == "Unknown"), "Source unknown")
    for name, context in WORK_CONTEXT.items():
        out = out.when(low == name, F.concat(work, F.lit(", " + context)))
    return out.otherwise(work)


def famous_work(author: Column, work: Column) -> Column:
    return F.coalesce(F.lower(author).isin(*WORK_AUTHORS), F.lit(False)) | F.coalesce(F.lower(work).isin(*WORK_AUTHORS), F.lit(False))


def audio_matches(shown: Column, spoken: Column) -> Column:
    """Whether the spoken text is the shown one, or a part of either, after white space is collapsed."""
    a, b = collapse(shown), collapse(spoken)
    return (a == b) | a.contains(b) | b.contains(a)
