"""Reply texts: clarifications, and what is said with the results of a search, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotegraph.functions.dialogue import ambiguous_term, mapped_author, source_info
from quotegraph.functions.text import bind, strip

# What the router asks back, by a word of the ambiguous term; the last is for every other term.
ROUTER_QUESTIONS = {
    "prophet": "**Which prophet do you mean?**\n\nPlease specify:\n- Muhammad\n- Moses\n- Jesus\n- Another specific prophet\n\nExample: \"quotes by Muhammad\" or \"quotes by Prophet Muhammad\"",
    "philosopher": "**Which philosopher do you mean?**\n\nPlease specify a name, for example:\n- Aristotle\n- Plato\n- Socrates\n- Kant\n- Nietzsche\n\nExample: \"quotes by Aristotle\"",
    "poet": "**Which poet do you mean?**\n\nPlease specify a name, for example:\n- Shakespeare\n- Rumi\n- Whitman\n- Dickinson\n\nExample: \"quotes by Rumi\"",
    "president": "**Which president do you mean?**\n\nPlease specify a name, for example:\n- Abraham Lincoln\n- George Washington\n- Thomas Jefferson\n- Barack Obama\n\nExample: \"quotes by Abraham Lincoln\"",
}
ROUTER_VAGUE = "**'%s' is too vague.**\n\nPlease provide a specific name.\n\nExample: Instead of '%s', try 'quotes by [specific name]'"
ROUTER_SHORT = "**Query too short.** Please provide at least 3 characters.\n\nExamples:\n- \"to be or not to be\"\n- \"quotes by Einstein\"\n- \"imagination is more important\""
# Names of authors that need a question, and the questions.
VAGUE_AUTHORS = ("the prophet", "a prophet", "the philosopher", "a philosopher", "the poet", "a poet", "the writer", "a writer", "the author", "a author", "the president", "a president", "the king", "a king")
AUTHOR_QUESTIONS = {
    "prophet": "**Clarification needed:** Which prophet do you mean?\n\nOptions:\n- Muhammad (Islamic prophet)\n- Moses (Biblical prophet)\n- Jesus (Christian prophet)\n- Other specific prophet?\n\nPlease specify the exact name.",
    "philosopher": "**Clarification needed:** Which philosopher do you mean?\n\nExamples: Aristotle, Plato, Socrates, Kant, Nietzsche, Descartes\n\nPlease specify the exact name.",
    "poet": "**Clarification needed:** Which poet do you mean?\n\nExamples: Shakespeare, Rumi, Whitman, Dickinson, Frost\n\nPlease specify the exact name.",
}
AUTHOR_VAGUE = "**Clarification needed:** '%s' is too ambiguous.\n\nPlease provide a specific name (e.g., 'Albert Einstein', 'Mark Twain')."
# What is said when nothing was found, or nothing that wasn't shown yet.
NONE_BY_AUTHOR = "**No results found** for '%s' in the Wikiquote database.\n\nSuggestions:\n- Check the spelling\n- Try the full name (e.g., 'Albert Einstein' not 'Einstein')\n- This person may not have a Wikiquote page"
NONE_TO_COMPLETE = "**I couldn't find a reliable match** in Wikiquote for that quote.\n\nTry:\n- A longer snippet (at least 5-6 words)\n- Different phrasing\n- Checking if the quote is actually from Wikiquote"
NONE_FOUND = "**No matching quotes found** in the database.\n\nTry rephrasing your query or searching for a specific author."
ALL_SHOWN = "I've already shown you all the matching quotes I found. Try a different query or ask for quotes from a different author."
NOT_HEARD = "I couldn't find a relevant quote for your question."
#: Results of a reply, and characters of a quote where it is cut.
MOST, CUT = 5, 150


def _by_word(term: Column, questions: dict[str, str], rest: Column) -> Column:
    out = None
    for word, question in questions.items():
        out = F.when(term.contains(word), question) if out is None else out.when(term.contains(word), question)
    return out.otherwise(rest)


def routing_question(query: Column) -> Column:
    """What the router asks back for an ambiguous or too short query; null for others."""
    vague = lambda term: _by_word(term, ROUTER_QUESTIONS, F.format_string(ROUTER_VAGUE, term, query))
    return bind(ambiguous_term(query), lambda term: F.when(term.isNotNull(), vague(term)).when(F.length(strip(F.lower(query))) < 3, ROUTER_SHORT))


def author_question(author: Column) -> Column:
    """What is asked back for an ambiguous author; null for others."""
    low = F.lower(author)
    vague = F.exists(F.array(*map(F.lit, VAGUE_AUTHORS)), lambda term: low.contains(term))
    return F.when(vague, _by_word(low, AUTHOR_QUESTIONS, F.format_string(AUTHOR_VAGUE, author)))


def nothing_found(intent: Column, entity: Column) -> Column:
    by_author = F.format_string(NONE_BY_AUTHOR, F.coalesce(entity, F.lit("that author")))
    return F.when(intent == "find_by_author", by_author).when(intent == "quote_completion", NONE_TO_COMPLETE).otherwise(NONE_FOUND)


def _named(work: Column) -> Column:
    return (F.coalesce(work, F.lit("")) != "") & (work != "Unknown")


def _cut(quote: Column) -> Column:
    return F.when(F.length(quote) <= CUT, quote).otherwise(F.concat(F.substring(quote, 1, CUT), F.lit("...")))


def _when(test: Column, *parts) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.concat(*parts)).otherwise("")


def reply(intent: Column, entity: Column, results: Column, found: Column) -> Column:
    """The reply to one query. ``results`` are the first MOST, as structs (quote, author, work), in order; ``found`` is how many there are."""
    first = results[0]
    listed = lambda line: F.array_join(F.transform(results, lambda r, i: line(r, F.concat(F.lit("**"), (i + 1).cast("string"), F.lit(".** \"")))), "")
    author = lambda r: mapped_author(r["author"], r["work"])["author"]
    more = _when(found > MOST, F.lit("\n*("), (found - MOST).cast("string"), F.lit(" more quotes available)*"))
    by = lambda r: F.concat(F.lit("   — "), author(r))
    of = lambda r: _when(_named(r["work"]), F.lit(", *"), r["work"], F.lit("*"))
    several = lambda: listed(lambda r, number: F.concat(number, _cut(r["quote"]), F.lit("\"\n"), by(r), of(r), F.lit("\n\n")))

    def single(who: Column) -> Column:
        note = F.when(who["confidence"] == "medium", "\n\n*Note: Commonly attributed to this author*").when(who["confidence"] == "low", "\n\n*Note: Attribution uncertain - verify independently*").otherwise("")
        return F.concat(F.lit("**Quote:** \""), first["quote"], F.lit("\"\n\n**Source:** "), who["author"], _when(_named(first["work"]), F.lit(" (from *"), first["work"], F.lit("*)")), note)

    def attributed(who: Column) -> Column:
        source = source_info(first["work"])
        note = F.when(who["confidence"] == "medium", "*Note: This quote is commonly attributed to this author.*\n").when(who["confidence"] == "low", "*Note: Attribution uncertain. Please verify independently.*\n").otherwise("")
        return F.concat(F.lit("**Author:** "), who["author"], F.lit("\n\n"), _when(source != "Source unknown", F.lit("**Source:** "), source, F.lit("\n\n")), F.lit("**Quote:** \""), first["quote"], F.lit("\"\n\n"), note)

    known = lambda f: bind(mapped_author(first["author"], first["work"]), f)
    by_author = F.concat(F.lit("**Quotes by "), author(first), F.lit(":**\n\n"), listed(lambda r, number: F.concat(number, r["quote"], F.lit("\"\n"), _when(_named(r["work"]), F.lit("   *Source: "), r["work"], F.lit("*\n")), F.lit("\n"))), more)
    by_work = F.concat(F.lit("**Quotes from** *"), F.coalesce(entity, F.lit("this work")), F.lit("*:\n\n"), listed(lambda r, number: F.concat(number, r["quote"], F.lit("\"\n\n"))), more)
    about = F.concat(F.lit("**Quotes about** *"), F.coalesce(entity, F.lit("this topic")), F.lit("*:\n\n"), listed(lambda r, number: F.concat(number, r["quote"], F.lit("\"\n"), by(r), F.lit("\n\n"))))
    any_one = F.concat(F.lit("**Random Quote:**\n\n\""), first["quote"], F.lit("\"\n\n— **"), author(first), F.lit("**"), of(first))
    return (
        F.when((intent == "quote_completion") & (found == 1), known(single))
        .when(intent == "quote_completion", F.concat(F.lit("**Found "), found.cast("string"), F.lit(" matching quotes:**\n\n"), several()))
        .when(intent == "quote_attribution", known(attributed))
        .when(intent == "find_by_author", by_author)
        .when(intent == "find_by_work", by_work)
        .when(intent == "random_quote", any_one)
        .when(intent == "quote_recommendation", about)
        .otherwise(F.concat(F.lit("**Search Results:**\n\n"), several()))
    )


def spoken_reply(quote: Column, author: Column, work: Column, speaker: Column) -> Column:
    """What a voice query is answered with: the best quote, its author and work, and for whom; the apology without a quote."""
    who = mapped_author(author, work)["author"]
    text = F.concat(F.lit("\""), quote, F.lit("\"\n\n— "), who, _when(_named(work), F.lit(", from *"), work, F.lit("*")), _when(speaker.isNotNull(), F.lit("\n\n*Personalized for "), speaker, F.lit("*")))
    return F.when(quote.isNotNull(), text).otherwise(NOT_HEARD)
