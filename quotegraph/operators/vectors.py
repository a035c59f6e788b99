"""Embeddings: cosine similarity, nearest neighbours, semantic review pairs, speaker profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegraph.functions.score import recommendation
from quotegraph.operators.components import connected_components
from quotegraph.plans.shared import materialize

SPEAKER_THRESHOLD = 0.55
#: Vectors of one block of the blocked neighbour search.
BLOCK_VECTORS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / F.when(size > 0, size).otherwise(1.0))


def speaker_similarity(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1; 0 for a zero vector."""
    return F.coalesce((cosine(a, b) + 1) / 2, F.lit(0.0))


def _blocked(df: DataFrame, role: bool, own: int, other: int) -> DataFrame:
    """``df`` (id, v) in its block, once for each block of the other side."""
    block, turn = ("q", "d") if role else ("d", "q")
    spread = df.withColumn(block, F.pmod(F.xxhash64("id"), F.lit(own))).withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))
    return spread.select("q", "d", "id", "v", F.lit(role).alias("asks"))


def nearest_among(asks: DataFrame, holds: DataFrame, k: int) -> DataFrame:
    """Exact ``(id, neighbour, similarity, position)``: for each of ``asks`` (id, v) the ``k`` of ``holds`` (id, v) with the greatest dot products.

    Both tables are cut into blocks of bounded size; each pair of blocks is one task's matrix
    product that returns only k rows a query, and a second step keeps the best k of those. Ids are
    longs; of equal products the least id goes first.
    """
    count = lambda df: max(1, -(-df.count() // BLOCK_VECTORS))
    n_asks, n_holds = count(asks), count(holds)

    def best(cell: pd.DataFrame) -> pd.DataFrame:
        q, d = cell[cell["asks"]], cell[~cell["asks"]]
        empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        if not len(q) or not len(d):
            return empty
        d = d.sort_values("id")
        ids, table, out = d["id"].to_numpy(), np.stack(d["v"].to_list()), []
        for at in range(0, len(q), 512):
            part = q.iloc[at : at + 512]
            score = np.stack(part["v"].to_list()) @ table.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), order.shape[1]), "neighbour": ids[order].ravel(), "similarity": np.take_along_axis(score, order, 1).ravel()}))
        return pd.concat(out)

    cells = _blocked(asks, True, n_asks, n_holds).unionByName(_blocked(holds, False, n_holds, n_asks))
    near = cells.groupBy("q", "d").applyInPandas(best, "id long, neighbour long, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return near.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def nearest(vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """:func:`nearest_among` all vectors for each of them, itself included."""
    flat = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return nearest_among(flat, flat, k)


def review_pairs(quotes: DataFrame, threshold: float = 0.94, k: int = 10, same_author: bool = True) -> DataFrame:
    """Candidate pairs of similar quotes for review: among each quote's ``k`` + 1 nearest, then by threshold and author.

    ``quotes`` has quote_id, text, author, embedding of unit length. Each unordered pair comes once.
    """
    near = nearest(quotes, k + 1, "quote_id").filter((F.col("id") != F.col("neighbour")) & (F.col("similarity") >= threshold))
    pairs = near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"), "similarity").groupBy("id_a", "id_b").agg(F.max("similarity").alias("raw"))
    side = lambda x: quotes.select(F.col("quote_id").alias(f"id_{x}"), F.col("author").alias(f"author_{x}"), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    if same_author:
        key = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
        both = both.filter((key("author_a") == key("author_b")) & (key("author_a") != ""))
    return both.select("id_a", "id_b", "author_a", "author_b", F.round("raw", 4).alias("similarity"), "text_a", "text_b", F.length("text_a").alias("len_a"), F.length("text_b").alias("len_b"), recommendation(F.col("raw"), F.col("text_a"), F.col("text_b")).alias("recommendation"))


def review_clusters(pairs: DataFrame) -> DataFrame:
    """``(node, component, size)`` of clusters among review pairs."""
    parts = materialize(connected_components(pairs, "id_a", "id_b"), "review-parts")
    return parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")


def _unit(df: DataFrame, id_col: str) -> DataFrame:
    """``(id, v)`` with v of unit length; zero vectors are left out."""
    flat = df.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("_n", norm(F.col("v"))).filter("_n > 0")
    return flat.select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def nearest_vector(probes: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(id, neighbour, similarity)``: of ``profiles`` (speaker, embedding) the likeliest for each of ``probes`` (probe_id, embedding), similarities moved to 0..1."""
    found = nearest_among(_unit(probes, "probe_id"), _unit(profiles, "speaker"), 1)
    return found.select("id", "neighbour", ((F.col("similarity") + 1) / 2).alias("similarity"))


def identify_speakers(probes: DataFrame, profiles: DataFrame, threshold: float = SPEAKER_THRESHOLD) -> DataFrame:
    """``(probe_id, speaker, similarity, identified)``: the likeliest profile of each probe.

    Of equal similarities the first speaker wins; nothing above 0, as for a zero vector, means no
    speaker and similarity 0. Speakers and probes have long ids.
    """
    found = nearest_vector(probes, profiles).withColumnRenamed("similarity", "_s")
    rows = probes.select("probe_id").join(found, F.col("probe_id") == F.col("id"), "left")
    similarity = F.coalesce("_s", F.lit(0.0))
    return rows.select("probe_id", F.when(similarity > 0, F.col("neighbour")).alias("speaker"), similarity.alias("similarity"), (similarity >= threshold).alias("identified"))


#: Columns of the table of speaker profiles.
PROFILE = ("speaker", "name", "embedding", "voice_preferences", "created_at", "last_seen", "sample_count")


def create_profiles(profiles: DataFrame | None, new: DataFrame, now: Column | None = None) -> DataFrame:
    """``profiles`` and a profile for each of ``new`` (speaker, name, embedding, voice_preferences: JSON or null).

    Preferences that aren't given are the default's; both times are ``now`` and the sample count is
    1. A speaker that has a profile keeps it.
    """
    now = F.current_timestamp() if now is None else now
    default = store_preferences(F.lit("default"), F.lit(1.0), F.lit(0.0))
    made = new.select("speaker", "name", "embedding", F.coalesce("voice_preferences", default).alias("voice_preferences"), now.alias("created_at"), now.alias("last_seen"), F.lit(1).alias("sample_count"))
    if profiles is None:
        return made
    return profiles.select(*PROFILE).unionByName(made.join(profiles.select("speaker"), "speaker", "left_anti").select(*PROFILE))


def get_profile(profiles: DataFrame, speaker) -> DataFrame:
    """The profile of one speaker, its preferences read; no row without one."""
    own = profiles.filter(F.col("speaker") == F.lit(speaker))
    return own.withColumn("voice_preferences", voice_preferences(F.col("voice_preferences")))


def list_profiles(profiles: DataFrame) -> DataFrame:
    """All profiles without their embeddings, those seen last first."""
    return profiles.select("speaker", "name", "created_at", "last_seen", "sample_count").orderBy(F.desc("last_seen"), "speaker")


def profile_embeddings(profiles: DataFrame) -> DataFrame:
    return profiles.select("speaker", "embedding")


def delete_profiles(profiles: DataFrame, speakers: DataFrame) -> DataFrame:
    """``profiles`` without those of ``speakers`` (speaker)."""
    return profiles.join(speakers.select("speaker").distinct(), "speaker", "left_anti").select(*profiles.columns)


def update_profiles(profiles: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """Profiles with new names and embeddings where ``updates`` (speaker, name, embedding) has them.

    The sample count rises by one with an embedding, and an update of either sets the time last
    seen, where the profiles have one.
    """
    new = updates.select(F.col("speaker").alias("_s"), F.col("name").alias("_n"), F.col("embedding").alias("_e"))
    joined = profiles.join(new, profiles["speaker"] == new["_s"], "left")
    changed = {"name": F.coalesce("_n", "name"), "embedding": F.coalesce("_e", "embedding"), "sample_count": F.col("sample_count") + F.col("_e").isNotNull().cast("int")}
    if "last_seen" in profiles.columns:
        changed["last_seen"] = F.when(F.col("_n").isNotNull() | F.col("_e").isNotNull(), F.current_timestamp() if now is None else now).otherwise(F.col("last_seen"))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in profiles.columns])


def voice_preferences(json: Column) -> Column:
    """``struct(voice_name, speed, pitch)`` as stored, or the default where nothing is stored or it isn't JSON."""
    kind = "struct<voice_name: string, speed: double, pitch: double>"
    parsed = F.from_json(json, kind)
    default = F.struct(F.lit("default").alias("voice_name"), F.lit(1.0).alias("speed"), F.lit(0.0).alias("pitch")).cast(kind)
    return F.when((json != "") & F.get_json_object(json, "$").isNotNull(), parsed).otherwise(default)


def store_preferences(voice_name: Column, speed: Column, pitch: Column) -> Column:
    """Preferences as the JSON text that a profile stores."""
    return F.to_json(F.struct(voice_name.alias("voice_name"), speed.alias("speed"), pitch.alias("pitch")))
