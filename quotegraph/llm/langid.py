"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts of n-grams (n = 1 to 3) by language are summed over all training rows: each task adds up
dense arrays, one a language, and emits them in pieces, so what is shuffled depends on languages
and bins, not on rows. The matrix of log probabilities (bins x languages) is broadcast, or mapped
from a shipped file when many languages make it large. Texts are scored in sparse batches: the
bins of all n-grams of many texts stand in one array, one gather takes their rows of the matrix,
and one segmented sum adds them up by text.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegraph.llm.tables import ship

BINS, PIECE, ALPHA = 1 << 14, 1 << 9, 0.5
#: Characters hashed at once, so a very long text needs no more memory than this; numbers gathered at once.
BLOCK, GATHERED = 1 << 18, 1 << 22
#: Bytes of a matrix that is broadcast; a larger one is shipped as a file and mapped.
BROADCAST_BYTES = 32 << 20
_LETTER = regex.compile(r"\p{L}")
_SALTS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor


def batches_of(texts: list[str | None], most: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places of texts and pieces of them, of some ``most`` characters together.

    Case is folded, and white space is one mark. A text of more than BLOCK characters comes in
    pieces, each with the two characters after it, in which its last n-grams end.
    """
    rows, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        text = " " + " ".join((text or "").lower().split()) + " "
        for at in range(0, len(text), BLOCK):
            rows.append(i)
            pieces.append(text[at : at + BLOCK + 2])
            held += len(pieces[-1])
            if held >= most:
                yield np.array(rows), pieces
                rows, pieces, held = [], [], 0
    if rows:
        yield np.array(rows), pieces


def ngram_bins(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3 the bins of all n-grams that begin in the first BLOCK characters of each piece, one piece after another, and how many are each's."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    one = codes * _SALTS[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _SALTS[1] + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _SALTS[2] + one[2:]
    for n, h in enumerate((one, two, three), 1):
        counts = np.clip(lengths - n + 1, 0, BLOCK)
        inside = np.ones(len(codes), bool)
        for end, length, count in zip(ends.tolist(), lengths.tolist(), counts.tolist()):
            inside[end - (length - count) : end] = False
        h = h[inside[: len(h)]]
        yield ((h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)) >> np.uint32(18), counts


def train_counts(rows: DataFrame) -> DataFrame:
    """``(lang, piece, counts)`` over all ``rows`` (text, lang), nulls left out."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            langs, codes = np.unique(b["lang"].to_numpy(object).astype(str), return_inverse=True)
            for lang, n in zip(langs, np.bincount(codes)):
                totals.setdefault(str(lang), np.zeros(BINS + 1, np.int64))[BINS] += n
            for lang in range(len(langs)):
                mine = totals[str(langs[lang])]
                for _, pieces in batches_of(b["text"][codes == lang].tolist(), BLOCK):
                    for bins, _ in ngram_bins(pieces):
                        mine[:BINS] += np.bincount(bins, minlength=BINS)
        for lang, counts in totals.items():
            pieces = [*counts[:BINS].reshape(-1, PIECE), counts[BINS:]]
            yield pd.DataFrame({"lang": lang, "piece": range(len(pieces)), "counts": pieces})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": part["lang"][:1], "piece": part["piece"][:1], "counts": [np.sum(np.stack(part["counts"].to_list()), axis=0)]})

    schema = "lang string, piece int, counts array<long>"
    return rows.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").mapInPandas(tally, schema).groupBy("lang", "piece").applyInPandas(add, schema)


class LanguageModel:
    """Log probabilities of bins (bins x languages) and languages; languages are in code point order."""

    def __init__(self, pieces: list[tuple[str, int, list[int]]]):
        self.langs = sorted({p[0] for p in pieces})
        counts, rows, place = np.zeros((len(self.langs), BINS)), np.zeros(len(self.langs)), {lang: i for i, lang in enumerate(self.langs)}
        for lang, piece, n in pieces:
            if piece * PIECE == BINS:
                rows[place[lang]] = n[0]
            else:
                counts[place[lang], piece * PIECE : (piece + 1) * PIECE] = n
        logs = np.log((counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * BINS)) if self.langs else counts
        self.logs, self.prior = np.ascontiguousarray(logs.T), np.log(rows / rows.sum()) if self.langs else rows

    def weigh(self, texts: list[str | None]) -> np.ndarray:
        """The log weight of each language (texts x languages)."""
        out = np.tile(self.prior, (len(texts), 1))
        for rows, pieces in batches_of(texts, max(1 << 10, min(BLOCK, GATHERED // max(1, len(self.langs))))):
            for bins, counts in ngram_bins(pieces):
                some = np.flatnonzero(counts)
                if len(some):
                    starts = (np.cumsum(counts) - counts)[some]
                    np.add.at(out, rows[some], np.add.reduceat(self.logs[bins], starts, axis=0))
        return out

    def predict_batch(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its probability; ``und`` and 0 without a letter."""
        asked = [i for i, t in enumerate(texts) if self.langs and t and _LETTER.search(t)]
        found, score = ["und"] * len(texts), np.zeros(len(texts))
        if asked:
            weight = self.weigh([texts[i] for i in asked])
            chance = np.exp(weight - weight.max(1, keepdims=True))
            best = chance.argmax(1)
            score[asked] = chance[np.arange(len(asked)), best] / chance.sum(1)
            for i, lang in zip(asked, best.tolist()):
                found[i] = self.langs[lang]
        return found, score


def fit(rows: DataFrame) -> LanguageModel:
    """The model of all ``rows`` (text, lang). What reaches the driver is languages x bins."""
    return LanguageModel([tuple(r) for r in train_counts(rows).collect()])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of each row; only doc_id and text are read.

    A null text, an empty one, or one without a letter is ``und`` with score 0, as is every text if
    the model saw no training row. Of equally likely languages the first by code point wins.
    """
    model_of = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of()
        for b in batches:
            langs, score = own.predict_batch(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": score})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def _shared(docs: DataFrame, model: LanguageModel):
    """A function that gives the model in a task."""
    spark, logs = docs.sparkSession, model.logs
    if logs.nbytes <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast(model)
        return lambda: sent.value
    out = io.BytesIO()
    np.save(out, logs)
    name = ship(spark, f"languages-{hashlib.sha256(out.getbuffer()).hexdigest()[:16]}.npy", out.getvalue())
    langs, prior = model.langs, model.prior

    def mapped() -> LanguageModel:
        own = LanguageModel([])
        own.langs, own.prior, own.logs = langs, prior, np.load(SparkFiles.get(name), mmap_mode="r")
        return own

    return mapped


def held_out_languages(docs: DataFrame, divisor: int = 4, fold: int = 2) -> DataFrame:
    """Learns from all rows outside the fold and predicts every row."""
    outside = docs.filter(F.coalesce(remainder(F.col("doc_id"), divisor), F.lit(-1)) != fold)
    found = identify(docs, fit(outside))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), divisor) == fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
