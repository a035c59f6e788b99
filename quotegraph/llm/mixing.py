"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should appear target / source size times. The whole part is given; the
fractional part is rounded by the pivotal method: two documents duel, and mass moves at random
until one of them is at 0 or 1, while the other goes on with what is left. What moves is words: a
document of s words that gains mass m takes m s words, and the other loses as many, so every duel
keeps the words of the source, and each direction's chance keeps both expectations.

The duels form a distributed tree. Documents of a source and an octave of size fold in blocks to
one residual each, and residuals in blocks again, until some 64 are left of an octave. Those of all
octaves fold last, the largest first: a large one's rest is taken up by the many smaller ones after
it, so that of each source one small document is left, which a last draw rounds. A block holds a
bounded number of rows at every level, however large the source, and rows that repeat one document
spread over blocks. Draws are hashes of ids, so reruns agree. Only DataFrame operations run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegraph.llm.tables import BROADCAST_ROWS, free_name, located, own_columns, part_place, spread_repeats
from quotegraph.plans.shared import materialize

#: Rows of a block, about, and how many residuals of an octave of a source are left to the last fold, and fold in a block: a power of 2.
BLOCK_ROWS, FAN_BITS, DUEL = 64, 6, 77
#: Rows of a table of sources, or of sources and octaves, that may be broadcast.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: words that the mix should take of each source.

    Weights repeat over sources in code point order, null last. Targets are proportional to
    weights, sum to ``share`` of all sizes, and stop at ``most`` times a source's size; the excess
    goes to the others by weight until none is above. One row a source; a rank over them needs one
    task, the rounds are aggregations.
    """
    kind = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    now = sizes.withColumn("_w", kind).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    now = materialize(now, "mix-weights")
    # a source is full if its cap divided by its weight is below the level, which rises from round to round
    level, full = 0.0, -1
    while True:
        stopped = F.col("_w") * F.lit(level) > F.col("_cap")
        row = now.agg(F.sum("source_size"), F.sum(F.when(stopped, F.col("_cap"))), F.sum(F.when(~stopped, F.col("_w"))), F.count_if(stopped)).first()
        if row[3] == full:
            break
        full = row[3]
        level = ((row[0] or 0) * share - (row[1] or 0.0)) / row[2] if row[2] else level
    stopped = F.col("_w") * F.lit(level) > F.col("_cap")
    return now.select("source", "source_size", F.when(stopped, F.col("_cap")).otherwise(F.col("_w") * F.lit(level)).alias("target"))


def _fold(items: Column) -> Column:
    """Runs the duels over an array of (neg_size, draw, key, mass) and gives it with new masses; all but the last are 0 or 1."""

    def duel(state: Column, x: Column) -> Column:
        held, a, b = state["held"], state["held"]["mass"], x["mass"]
        s, t = -held["neg_size"].cast("double"), -x["neg_size"].cast("double")
        rise, fall = F.least((1 - a) * s, b * t), F.least(a * s, (1 - b) * t)  # words that can move to the held one, and from it
        # hashed anew: items may be sorted by their draws, which as they stand would rise along the fold
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(DUEL), x["draw"]), 11) / F.lit(float(1 << 53))
        up = draw * (rise + fall) < fall
        moved = F.when(up, rise).otherwise(-fall)
        held_ends = F.when(up, (1 - a) * s <= b * t).otherwise(a * s <= (1 - b) * t)
        with_mass = lambda one, mass: F.struct(one["neg_size"].alias("neg_size"), one["draw"].alias("draw"), one["key"].alias("key"), mass.alias("mass"))
        held_end, x_end = with_mass(held, F.when(up, 1.0).otherwise(0.0)), with_mass(x, F.when(up, 0.0).otherwise(1.0))
        goes_on = F.when(held_ends, with_mass(x, b - moved / t)).otherwise(with_mass(held, a + moved / s))
        return F.struct(goes_on.alias("held"), F.concat(state["done"], F.array(F.when(held_ends, held_end).otherwise(x_end))).alias("done"))

    start = F.struct(F.element_at(items, 1).alias("held"), F.slice(items, 1, 0).alias("done"))
    folded = F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, duel)
    return F.concat(folded["done"], F.array(folded["held"]))


def _level(rows: DataFrame, group: list, carry: list[str]) -> DataFrame:
    """One level: each group of ``rows`` (size, draw, mass, carried columns) folds; all its rows come back with new masses."""
    item = F.struct((-F.col("size")).alias("neg_size"), "draw", F.struct(*carry).alias("key"), "mass")
    folded = rows.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("_items")).select(F.explode(_fold(F.col("_items"))).alias("_x"))
    return folded.select(*[F.col(f"_x.key.{c}").alias(c) for c in carry], (-F.col("_x.neg_size")).alias("size"), F.col("_x.draw").alias("draw"), F.col("_x.mass").alias("mass"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 5) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, _file, _row)`` for each row of ``docs`` (doc_id, text, source; other columns are ignored).

    The size is the number of words; a null text has none. Documents without words get no copies,
    as do all when the table has no words. Null sources are one source. Repeated rows are rounded
    one by one; those and rows without an id draw by their place in the table's files, so they too
    spread over blocks. An empty table gives an empty result. No document appears more than
    ceil(``most``) times. Ids may be of any type that can be cast to a string.
    """
    return _mix(*located(docs, "mix-source"), weights, share, most, seed)


def _joined(rows: DataFrame, side: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the columns of the small written table ``side``, matched by ``names``, nulls included."""
    other = side.select(*[F.col(c).alias(f"_s{c}") for c in names], *[c for c in side.columns if c not in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    return rows.join(F.broadcast(other) if side.count() <= BROADCAST_SOURCES else other, same).drop(*[f"_s{c}" for c in names])


def _mix(docs: DataFrame, file: str, row: str, weights, share, most, seed) -> DataFrame:
    at = part_place(file, row)
    size = words(F.col("text"))
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), size, F.when(F.col("doc_id").isNull(), at))
    octave = F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(F.lit(-1)).cast("int")
    slim = docs.select("doc_id", "source", size.alias("size"), octave.alias("_octave"), draw.alias("draw"), at.alias("_at"), F.col(file).alias("_file"), F.col(row).alias("_row"))
    slim = materialize(slim.withColumn("_id", F.monotonically_increasing_id()), "mix-sizes")
    drawn = spread_repeats(slim.select("_id", "source", "size", "_octave", "draw", "_at"), "draw", "_at")

    counts = materialize(slim.groupBy("source", "_octave").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("_rows")), "mix-counts")
    goals = materialize(targets(counts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mixed = _joined(drawn, goals, ["source"])
    mixed = mixed.select("_id", "source", "size", "_octave", "draw", F.floor(rate).cast("long").alias("_whole"), F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("mass"))
    # an octave's rows fold in blocks if they are more than the last fold takes
    bits = f"CASE WHEN _rows <= {1 << FAN_BITS} THEN 63 ELSE CAST(greatest({FAN_BITS}, ceil(log2(_rows / {float(BLOCK_ROWS)}))) AS INT) END"
    mixed = _joined(mixed, materialize(counts.select("source", "_octave", F.expr(bits).alias("_bits")), "mix-bits"), ["source", "_octave"])
    mixed = mixed.withColumn("_block", F.when(F.col("_bits") < 63, F.xxhash64(F.lit(seed + 1), "draw").bitwiseAND(F.expr("shiftleft(1L, _bits) - 1"))).otherwise(F.lit(-1).cast("long")))
    mixed = materialize(mixed, "mix-masses")

    leaf = ["source", "_octave", "_block", "_bits"]
    open_ = (F.col("mass") > 0) & (F.col("mass") < 1)
    key = ["_id", "_whole", *leaf]
    rest, level = mixed.filter(open_), 0
    settled = [mixed.filter(~open_)]
    deepest = rest.agg(F.max(F.when(F.col("_bits") < 63, F.col("_bits")))).first()[0]
    while deepest is not None and (level == 0 or FAN_BITS * (level - 1) < deepest - FAN_BITS):
        # blocks, then 2 ** FAN_BITS neighbours of them, until that many are left of an octave
        folds = (F.col("_bits") < 63) & (F.lit(FAN_BITS * (level - 1)) < F.col("_bits") - FAN_BITS) if level else F.col("_bits") < 63
        group = ["source", "_octave", F.expr(f"shiftrightunsigned(_block, CAST(least({FAN_BITS * level}, _bits - {FAN_BITS}) AS INT))")]
        after = materialize(_level(rest.filter(folds).withColumn("draw", F.xxhash64(F.lit(seed + level), "draw")), group, key), f"mix-level{level}")
        settled.append(after.filter(~open_))
        rest = after.filter(open_).unionByName(rest.filter(~folds))
        level += 1
    last = materialize(_level(rest.withColumn("draw", F.xxhash64(F.lit(seed + level), "draw")), ["source"], key), "mix-last")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("draw")), 11) / F.lit(float(1 << 53))
    settled.append(last.withColumn("mass", F.when(open_, F.when(chance < F.col("mass"), 1.0).otherwise(0.0)).otherwise(F.col("mass"))))
    done = None
    for part in settled:
        part = part.select("_id", (F.col("_whole") + F.col("mass").cast("long")).alias("_copies"))
        done = part if done is None else done.unionByName(part)
    found = _joined(slim.join(done, "_id"), goals, ["source"])
    return found.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("_copies")).otherwise(F.lit(0).cast("long")).alias("copies"), "_file", "_row")


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 5) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns, extra ones of any name too."""
    whole, file, row = located(docs, "mix-source")
    copies, turn = free_name(whole.columns, "_copies"), free_name(whole.columns, "_turn")
    taken = _mix(whole, file, row, weights, share, most, seed).filter("copies > 0").select(F.col("_file").alias(file), F.col("_row").alias(row), F.col("copies").cast("int").alias(copies))
    taken = materialize(taken, "mix-taken")
    side = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken
    return whole.join(side, [file, row]).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*own_columns(docs))
