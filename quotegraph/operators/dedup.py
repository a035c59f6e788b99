"""Duplicates among quotes: exact groups, blocking, similarity, clusters, canonical picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegraph.functions.score import ratio_reaches
from quotegraph.functions.text import S, bind, dedup_form, layered_form, strip
from quotegraph.operators.components import connected_components
from quotegraph.operators.graph import checked_broadcast, first_of_block
from quotegraph.plans.shared import materialize, spread

# Words that the layered dedup's content tokens leave out.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "be", "as",
    "this", "that", "was", "are", "were", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "can", "not", "no", "so", "if", "its", "than", "then", "there", "their", "they", "we", "you", "he", "she", "i", "my", "your",
    "his", "her", "our", "what", "which", "who", "all", "when", "up", "more", "about", "into", "out", "only", "also", "just", "every",
)
LEAST_LENGTH, LEAST_BLOCK, MOST_BLOCK = 15, 2, 500
#: Edit distances that are tried before a larger one, which takes time in proportion.
EDIT_BANDS = (16, 128)


def word_list(form: Column) -> Column:
    """The words of a normal form; an empty one has none."""
    return F.filter(F.split(form, rf"{S}+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of words; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def edit_at_least(a: Column, b: Column, threshold: float, bands: tuple[int, ...] = ()) -> Column:
    """Whether :func:`edit_similarity` reaches ``threshold``; lengths are tried first, and distances only as far as they may go.

    Distances within ``bands``, ascending, are tried before: texts that differ little end in a narrow one.
    """
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    most = F.floor(longest * (1.0 - threshold) + 1e-6).cast("int")
    near = bind(F.call_function("levenshtein", a, b, most), lambda d: (d >= 0) & (F.when(longest == 0, 1.0).otherwise(1.0 - d / F.greatest(longest, F.lit(1))) >= threshold))
    for band in reversed(bands):
        near = F.when((most > band) & (F.call_function("levenshtein", a, b, F.lit(band)) >= 0), True).otherwise(near)
    return F.when(shortest >= longest * threshold, near).otherwise(False)


def rare_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two sets of rare words; two empty ones share nothing."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).otherwise(jaccard(a, b))


def two_of_three(similar: Column, rare: Column, edit: Column) -> Column:
    """At least two signals, where the edit signal only counts beside another."""
    return (similar & rare) | ((similar | rare) & edit)


def shingles(form: Column, k: int = 3) -> Column:
    """Distinct runs of ``k`` characters; a shorter text is one.

    Runs are sliced from the array of characters: taking each from the text would walk it anew.
    """
    letters = F.split(form, "")
    runs = letters
    for j in range(1, k):  # the arrays are arguments, so each is made once, not anew for each element
        runs = F.zip_with(runs, F.slice(letters, F.lit(j + 1), F.greatest(F.length(form) - j, F.lit(0))), lambda a, b: F.concat(a, b))
    whole = F.slice(runs, F.lit(1), F.greatest(F.length(form) - (k - 1), F.lit(0)))
    return F.when(F.length(form) < k, F.array(form)).otherwise(F.array_distinct(whole))


def minhash_signatures(forms: DataFrame, permutations: int = 128, k: int = 3) -> DataFrame:
    """``(quote_id, signature)`` of ``forms`` (quote_id, form): the least seeded hash of a text's shingles under each permutation.

    Shingles are exploded and aggregated, which stays in generated code and combines within tasks.
    """
    parts = forms.select("quote_id", F.explode(shingles(F.col("form"), k)).alias("_s"))
    least = parts.groupBy("quote_id").agg(*[F.min(F.xxhash64(F.lit(p), "_s")).alias(f"_p{p}") for p in range(permutations)])
    return least.select("quote_id", F.array(*[f"_p{p}" for p in range(permutations)]).alias("signature"))


def exact_form_groups(quotes: DataFrame) -> DataFrame:
    """``(quote_id, quote_hash, group_size, first_id)`` of quotes whose normal form has 15 characters or more.

    Forms are made once; what is grouped and joined is a written table of hashes.
    """
    own = bind(dedup_form(F.col("text")), lambda form: F.when(F.length(form) >= LEAST_LENGTH, F.substring(F.sha2(form, 256), 1, 16)))
    hashed = materialize(spread(quotes.select("quote_id", "text")).select("quote_id", own.alias("quote_hash")), "dedup-hashes").filter("quote_hash IS NOT NULL")
    groups = hashed.groupBy("quote_hash").agg(F.count(F.lit(1)).alias("group_size"), F.min("quote_id").alias("first_id"))
    return hashed.join(groups, "quote_hash")


def blocking_keys(form: Column) -> Column:
    """First five words, last five, and a length bucket with the three longest; none for short forms."""

    def keys(words: Column) -> Column:
        placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
        longest = F.array_sort(F.transform(F.slice(F.sort_array(placed), 1, 3), lambda x: x["w"]))
        bucket = (F.floor(F.length(form) / 10) * 10).cast("string")
        own = F.array(
            F.concat(F.lit("pfx:"), F.concat_ws(" ", F.slice(words, 1, 5))),
            F.concat(F.lit("sfx:"), F.concat_ws(" ", F.slice(words, F.greatest(F.size(words) - 4, F.lit(1)), F.lit(5)))),
            F.concat(F.lit("len"), bucket, F.lit(":"), F.concat_ws("_", longest)),
        )
        return F.when((F.size(words) >= 3) & (F.length(form) >= LEAST_LENGTH), own).otherwise(F.array().cast("array<string>"))

    return bind(word_list(form), keys)


def blocking_keys(form: Column) -> Column:
    """First five words, last five, and a length bucket with the three longest; none for short forms."""
    words = word_list(form)
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    longest = F.array_sort(F.transform(F.slice(F.array_sort(placed), 1, 3), lambda x: x["w"]))
    bucket = (F.floor(F.length(form) / 10) * 10).cast("string")
    keys = F.array(
        F.concat(F.lit("pfx:"), F.concat_ws(" ", F.slice(words, 1, 5))),
        F.concat(F.lit("sfx:"), F.concat_ws(" ", F.slice(words, F.greatest(F.size(words) - 4, F.lit(1)), F.lit(5)))),
        F.concat(F.lit("len"), bucket, F.lit(":"), F.concat_ws("_", longest)),
    )
    return F.when((F.size(words) >= 3) & (F.length(form) >= LEAST_LENGTH), keys).otherwise(F.array().cast("array<string>"))


def block_pairs(keyed: DataFrame, id_col: str = "quote_id", least: int = LEAST_BLOCK, most: int = MOST_BLOCK, size: str | None = None, ratio: float = 0.0) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, that share a key whose block has ``least`` to ``most`` rows.

    Block sizes come from a partial aggregation, so an oversized block never meets in a task; the
    kept ones are bounded, and so are their pairs. With ``size``, a column, only pairs whose sizes
    are to each other as ``ratio`` or more.
    """
    n = F.lit(0) if size is None else F.col(size)
    keyed = materialize(keyed.select(F.col(id_col).alias("id"), F.xxhash64("key").alias("k"), F.col("key"), n.alias("n")).distinct(), "block-keys")
    fair = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many").between(least, most)).select("k", "key")
    kept = materialize(keyed.join(fair, ["k", "key"], "left_semi").select("k", "key", "id", "n"), "block-rows")
    a, b = (kept.select("k", "key", F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = a.join(b, (a["k"] == b["k"]) & (a["key"] == b["key"]) & (a["a"] < b["b"]) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * ratio))
    return met.select("a", "b").distinct()


def near_pairs(quotes: DataFrame, threshold: float = 0.90, edits: bool = True) -> DataFrame:
    """Pairs ``(a, b)`` that share a block and whose words, or with ``edits`` characters, agree to ``threshold``.

    Sizes of word sets go with the keys and are tried before the sets; sets, of 64-bit hashes, are
    tried before characters. Sets and forms aren't carried through the pair shuffle: ids are paired
    first, then rows fetched.
    """
    own = bind(dedup_form(F.col("text")), lambda form: F.when(F.length(form) >= LEAST_LENGTH, F.struct(form.alias("form"), F.array_distinct(F.transform(word_list(form), lambda w: F.xxhash64(w))).alias("words"), blocking_keys(form).alias("keys"))))
    forms = materialize(spread(quotes.select("quote_id", "text")).select("quote_id", own.alias("f")).filter("f IS NOT NULL").select("quote_id", "f.*"), "dedup-forms")
    gate = threshold - 0.15 if edits else threshold
    sizes = forms.select("quote_id", F.size("words").alias("n"), F.explode("keys").alias("key"))
    close = materialize(block_pairs(sizes, size="n", ratio=gate), "dedup-close")
    side = lambda c: forms.select(F.col("quote_id").alias(c), F.col("form").alias(f"form_{c}"), F.col("words").alias(f"words_{c}"))
    scored = close.join(side("a"), "a").join(side("b"), "b").withColumn("jaccard", jaccard(F.col("words_a"), F.col("words_b"))).filter(F.col("jaccard") >= gate)
    if edits:
        scored = scored.filter((F.col("jaccard") >= threshold) | edit_at_least(F.col("form_a"), F.col("form_b"), threshold))
    return scored.select("a", "b", "jaccard")


def canonical_order(has_person: Column, has_work: Column, quality_score: Column, text: Column) -> list[Column]:
    """Sort order of a cluster's members: the first is canonical."""
    rank = F.when(has_person, 1000).otherwise(0) + F.when(has_work, 500).otherwise(0) + 10 * F.coalesce(quality_score, F.lit(0))
    return [F.desc(rank), F.asc(F.least(F.abs(F.length(text) - 100), F.lit(500)))]


def dedup_updates(quotes: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Update rows of the whole dedup: exact groups, then near clusters among their canonical members.

    ``quotes`` has quote_id, text, quality_score, has_person, has_work. Result: quote_id,
    is_canonical, canonical_quote_id, root_canonical_id, duplicate_type, duplicate_group_id,
    quote_hash. root_canonical_id follows a canonical that is itself a near duplicate.
    """
    order = canonical_order(F.col("has_person"), F.col("has_work"), F.col("quality_score"), F.col("text"))
    groups = exact_form_groups(quotes)
    best = Window.partitionBy("quote_hash").orderBy(*order, "quote_id")
    exact = quotes.join(groups, "quote_id").withColumn("_rn", F.row_number().over(best)).withColumn("_exact", F.first("quote_id").over(best))
    exact = materialize(exact, "dedup-exact")
    alive = exact.filter("_rn = 1").select(*quotes.columns)
    parts = connected_components(near_pairs(alive, threshold), "a", "b").select(F.col("node").alias("quote_id"), "component")
    pick = Window.partitionBy("component").orderBy(*order, "quote_id")
    near = materialize(alive.join(parts, "quote_id").withColumn("_near", F.first("quote_id").over(pick)).select("quote_id", "component", "_near"), "dedup-near")
    out = exact.join(near, "quote_id", "left").join(near.select(F.col("quote_id").alias("_exact"), F.col("_near").alias("_root")), "_exact", "left")
    is_near = F.col("component").isNotNull()
    demoted = is_near & (F.col("_near") != F.col("quote_id"))
    kind = F.when(F.col("_rn") > 1, "exact").when(demoted, "near")
    pointer = F.when(F.col("_rn") > 1, F.col("_exact")).when(demoted, F.col("_near"))
    group = F.when(is_near, F.concat(F.lit("near_"), F.col("component"))).when(F.col("group_size") > 1, F.concat(F.lit("exact_"), F.col("first_id")))
    return out.select("quote_id", kind.isNull().alias("is_canonical"), pointer.alias("canonical_quote_id"), F.when(kind.isNotNull(), F.coalesce("_root", pointer)).alias("root_canonical_id"), kind.alias("duplicate_type"), group.alias("duplicate_group_id"), "quote_hash")


def layered_exact(quotes: DataFrame, compose: bool = True) -> DataFrame:
    """``(quote_id, first_id)``: the first quote with the same layered normal form, without a length guard."""
    hashed = quotes.select("quote_id", F.sha2(layered_form(F.col("text"), compose), 256).alias("_h"))
    return hashed.join(hashed.groupBy("_h").agg(F.min("quote_id").alias("first_id")), "_h").select("quote_id", "first_id")


def rare_words(words: DataFrame) -> DataFrame:
    """Words seen more than once and at most as often as the cutoff: the element at index max(1, 5 %) of all sorted counts, 20 at most.

    ``words`` has one row (word) for each occurrence. The cutoff comes from how many words have each
    count, a table as small as the largest distinct counts are few.
    """
    counts = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = counts.count()
    at = min(max(1, int(total * 0.05)), max(0, total - 1))
    spread = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    below = spread.filter("n <= 20").orderBy("n").collect()  # 20 rows at most: a higher cutoff counts as 20
    cutoff, seen = 20, 0
    for n, many in below:
        seen += many
        if seen > at:
            cutoff = n
            break
    return counts.filter((F.col("n") > 1) & (F.col("n") <= cutoff))


def layered_near(quotes: DataFrame, threshold: float = 0.82, compose: bool = True) -> DataFrame:
    """``(quote_id, keep_id)`` of clusters of two or more quotes by the layered rules; the longest stays.

    Four keys: first ten words, length bucket, eight content words sorted, six rare words. Of an
    oversized block the first 500 by id are compared, which is what the operator is defined to do.
    """
    forms = quotes.select("quote_id", "text", layered_form(F.col("text"), compose).alias("form"))
    forms = forms.withColumn("words", word_list(F.col("form"))).withColumn("content", F.filter("words", lambda w: ~w.isin(*STOP_WORDS)))
    forms = materialize(forms, "layered-forms")
    rare = checked_broadcast(rare_words(forms.select(F.explode("words").alias("word"))).select("word"))
    own = forms.select("quote_id", F.explode(F.array_distinct("content")).alias("word")).join(rare, "word").groupBy("quote_id").agg(F.array_sort(F.collect_list("word")).alias("rare"))
    full = materialize(forms.join(own, "quote_id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>"))), "layered-full")
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("pfx:"), F.concat_ws(" ", F.slice("words", 1, 10))),
            F.concat(F.lit("len:"), (F.floor(F.length("form") / 10) * 10).cast("string")),
            F.concat(F.lit("cnt:"), F.concat_ws("|", F.array_sort(F.slice("content", 1, 8)))),
            F.when(F.size("rare") > 0, F.concat(F.lit("rare:"), F.concat_ws("|", F.slice("rare", 1, 6)))),
        )
    )
    keyed = full.select("quote_id", F.explode(keys).alias("key"))
    sample = materialize(first_of_block(keyed, "key", "quote_id", MOST_BLOCK), "layered-blocks")
    a, b = sample.select("key", F.col("quote_id").alias("a")), sample.select("key", F.col("quote_id").alias("b"))
    pairs = materialize(a.join(b, "key").filter("a < b").select("a", "b").distinct(), "layered-pairs")
    side = lambda c: full.select(F.col("quote_id").alias(c), F.col("form").alias(f"form_{c}"), F.array_distinct("words").alias(f"words_{c}"), F.col("rare").alias(f"rare_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    similar = jaccard(F.col("words_a"), F.col("words_b")) >= threshold
    shares = rare_overlap(F.col("rare_a"), F.col("rare_b")) >= threshold
    hits = both.filter(similar | shares).filter((similar & shares) | edit_at_least(F.col("form_a"), F.col("form_b"), threshold)).select("a", "b")
    parts = connected_components(hits, "a", "b")
    longest = Window.partitionBy("component").orderBy(F.desc(F.length("text")), "quote_id")
    return quotes.join(parts, quotes["quote_id"] == parts["node"]).select("quote_id", F.first("quote_id").over(longest).alias("keep_id"))


def set_bits(hashes: Column, longs: int) -> Column:
    """A set of hashes as ``longs`` times 64 bits."""
    own = lambda i: F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(longs - 1)) == i)
    return F.transform(F.sequence(F.lit(0), F.lit(longs - 1)), lambda i: F.aggregate(own(i), F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))))


def most_shared(size: Column, bits: Column, others: Column) -> Column:
    """How many of ``size`` members two sets can share by their :func:`set_bits`: a bit that the other lacks is a member that it lacks."""
    return size - F.aggregate(F.zip_with(bits, others, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)


def pair_signals(pairs: DataFrame, forms: DataFrame, threshold: float = 0.82) -> DataFrame:
    """``(a, b, similar, rare, edit, duplicate)`` for ``pairs`` (a, b): each signal of the vote, and its outcome.

    ``forms`` has quote_id, form and rare (an array of distinct rare words). Sizes of sets go to all
    pairs; bits of sets to those whose sizes allow a signal, sets of 64-bit hashes to those whose bits
    do, and texts to those that have a signal and differ. Distances are tried with narrow bands first.
    """
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    sets = materialize(spread(forms).select("quote_id", F.sha2("form", 256).alias("form"), F.array_distinct(hashed(word_list(F.col("form")))).alias("words"), hashed(F.col("rare")).alias("rare")), "signal-sets")
    kinds = {"words": 16, "rare": 4}
    lean = materialize(sets.select("quote_id", *[c for k, longs in kinds.items() for c in (F.size(k).alias(f"n_{k}"), set_bits(F.col(k), longs).alias(f"bits_{k}"))]), "signal-bits")

    def both(rows: DataFrame, table: DataFrame, *names: str) -> DataFrame:
        for c in "ab":
            rows = rows.join(table.select(F.col("quote_id").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in names]), c)
        return rows

    def bound(kind: str, shared: Column) -> Column:  # of the Jaccard similarity, if so many members are shared
        return shared >= (F.col(f"n_{kind}_a") + F.col(f"n_{kind}_b") - shared) * (threshold - 1e-9)

    def can(kind: str) -> Column:
        a, b = ([F.col(f"{x}_{kind}_{c}") for x in ("n", "bits")] for c in "ab")
        return bound(kind, F.least(most_shared(*a, b[1]), most_shared(*b, a[1])))

    known = materialize(both(pairs, lean, "n_words", "n_rare"), "signal-pairs")
    sized = known.filter(F.coalesce(bound("words", F.least("n_words_a", "n_words_b")) | bound("rare", F.least("n_rare_a", "n_rare_b")) & (F.col("n_rare_a") > 0), F.lit(False)))
    able = materialize(both(sized, lean, "bits_words", "bits_rare").filter(can("words") | can("rare") & (F.col("n_rare_a") > 0)).select("a", "b"), "signal-able")
    signs = both(able, sets, "form", "words", "rare").select(
        "a",
        "b",
        (jaccard(F.col("words_a"), F.col("words_b")) >= threshold).alias("similar"),
        (rare_overlap(F.col("rare_a"), F.col("rare_b")) >= threshold).alias("rare"),
        (F.col("form_a") == F.col("form_b")).alias("same"),
    )
    hits = materialize(signs.filter(F.col("similar") | F.col("rare")), "signal-hits")
    texts = both(hits.filter(~F.col("same")).select("a", "b"), forms.select("quote_id", "form"), "form")
    near = texts.select("a", "b", edit_at_least(F.col("form_a"), F.col("form_b"), threshold, EDIT_BANDS).alias("near"))
    voted = hits.join(near, ["a", "b"], "left").select("a", "b", "similar", "rare", (F.col("same") | F.coalesce("near", F.lit(False))).alias("edit"))
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    signals = known.select("a", "b").join(voted, ["a", "b"], "left").select("a", "b", false("similar"), false("rare"), false("edit"))
    return signals.withColumn("duplicate", two_of_three(F.col("similar"), F.col("rare"), F.col("edit")))


def ratio_candidates(texts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(a, b)``, a < b, of ``texts`` (quote_id, key): every pair whose sequence ratio can reach ``threshold``.

    The ratio leaves (1 - threshold) (m + n) characters of both texts unmatched at most. Each breaks
    one of the longer text's disjoint pieces, so with one piece more than that, a piece stands whole
    in the other text, shifted by as many places at most. No piece is skipped, however common.
    """
    slack, reach = 2.0 * (1.0 - threshold), (2.0 - threshold) / threshold
    most = lambda n: F.floor(n * slack + 1e-6).cast("int")
    width = lambda n: F.floor(n / (most(n) + 1)).cast("int")
    lean = texts.select("quote_id", "key", F.length("key").alias("n")).filter("n > 0")
    own = lean.select("*", F.sequence(F.lit(1), (most(F.col("n")) * width(F.col("n")) + 1).cast("int"), width(F.col("n"))).alias("_at"), width(F.col("n")).alias("w"))
    pieces = own.select("quote_id", "key", "n", "w", F.explode("_at").alias("at")).select("w", F.expr("xxhash64(substring(key, at, w))").alias("piece"), "at", "n", F.col("quote_id").alias("long"))
    widths = F.array_distinct(F.transform(F.sequence(F.col("n"), F.floor(F.col("n") * reach + 1e-6).cast("int")), width))
    asked = lean.select("quote_id", "key", "n", F.explode(widths).alias("w")).filter("w BETWEEN 1 AND n").select("quote_id", "key", "n", "w", F.explode(F.expr("sequence(1, n - w + 1)")).alias("spot"))
    asked = asked.select("w", F.expr("xxhash64(substring(key, spot, w))").alias("piece"), "spot", F.col("n").alias("m"), F.col("quote_id").alias("short"))
    pieces, asked = materialize(pieces, "ingest-pieces"), materialize(asked, "ingest-asked")
    fits = (F.col("long") != F.col("short")) & (F.col("m") <= F.col("n")) & (2.0 * F.col("m") >= threshold * (F.col("m") + F.col("n")) - 1e-6) & (F.abs(F.col("at") - F.col("spot")) <= most(F.col("n")))
    return pieces.join(asked, ["w", "piece"]).filter(fits).select(F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b")).distinct()


def ingest_dedup(quotes: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Quotes without repeats and near repeats, as the quality filter keeps them: ``(quote_id, key)``.

    The first of equal keys (lower case, stripped) stays; then one goes if an earlier one is similar
    by sequence ratio. The defined order-dependent memory of the last thousand texts has no parallel
    form, so each is compared with all earlier ones that can be so similar, whatever lies between
    them; and a text goes too if the earlier one that it resembles went.
    """
    keys = quotes.select("quote_id", F.lower(strip(F.coalesce("text", F.lit("")))).alias("key"))
    first = materialize(keys.groupBy("key").agg(F.min("quote_id").alias("quote_id")), "ingest-first")
    side = lambda c: first.select(F.col("quote_id").alias(c), F.col("key").alias(f"key_{c}"))
    pairs = materialize(ratio_candidates(first, threshold), "ingest-candidates")
    near = materialize(pairs.join(side("a"), "a").join(side("b"), "b"), "ingest-pairs")
    hits = near.filter(ratio_reaches(threshold)(F.col("key_b"), F.col("key_a")))
    return first.join(hits.select(F.col("b").alias("quote_id")).distinct(), "quote_id", "left_anti").select("quote_id", "key")
