"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words fall into hashed buckets. Each bucket has a sparse random index vector of signs; its word
vector is the sum of the index vectors of its neighbours over all documents, scaled to unit length.
A document is pooled into the mean of its words' vectors and of their index vectors (two marks, for
capitals and for a word that repeats the one before, are words like others). A two-layer network in
numpy, fitted on a bounded sample of labelled rows, gives the probability; a temperature fitted on
rows kept apart calibrates it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegraph.llm.tables import free_name

BUCKETS, DIM, SIGNS, PIECE = 1 << 13, 64, 2, 64
PAD, CAPITALS, REPEAT = BUCKETS - 1, BUCKETS - 2, BUCKETS - 3
WINDOW = 2
#: Labelled rows that fit the network, at most: those with the least hashes of their ids.
TRAIN_ROWS = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 20, 128, 2e-3, 1e-4
_TOKEN = regex.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Characters tokenized at once in a very long text.
BLOCK = 1 << 20


def remainder(doc_id: Column, divisor: int) -> Column:
    return F.crc32(doc_id.cast("string")) % divisor


class _Buckets(dict):
    """Token to its bucket, with BUCKETS added for words in capitals."""

    def __missing__(self, token: str) -> int:
        bucket = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % REPEAT
        value = bucket + BUCKETS * (len(token) > 1 and token.isupper())
        if len(token) < 64:
            if len(self) > 1 << 18:
                self.clear()
            self[token] = value
        return value


_BUCKETS = _Buckets()


def token_buckets(text: str | None) -> tuple[np.ndarray, int]:
    """The bucket of each token, and how many are in capitals."""
    text = text or ""
    parts, at = [], 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not text[end].isspace() and end < at + 2 * BLOCK:
            end += 1
        tokens = _TOKEN.findall(text, at, min(end, len(text)))
        parts.append(np.fromiter(map(_BUCKETS.__getitem__, tokens), np.int32, len(tokens)))
        at = end
    both = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return both & (BUCKETS - 1), int((both >= BUCKETS).sum())


def index_vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Positions (buckets x SIGNS) and signs of the index vectors. PAD has none: its signs are 0."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :SIGNS].astype(np.int64)
    sign = rng.integers(0, 2, (BUCKETS, SIGNS)) * 2 - 1
    sign[PAD] = 0
    return at, sign


def neighbour_sums(docs: DataFrame) -> DataFrame:
    """``(piece, sums)``: summed index vectors of every bucket's neighbours over all whole texts."""
    at, sign = index_vectors()
    flat = 2 * at + (sign < 0)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS * DIM * 2, np.int64)

        def add(words: np.ndarray) -> None:
            for gap in range(1, WINDOW + 1):
                for own, other in ((words[gap:], words[:-gap]), (words[:-gap], words[gap:])):
                    own, other = own[keep := (own != PAD) & (other != PAD)], other[keep]
                    for s in range(SIGNS):
                        np.add(total, np.bincount(own.astype(np.int64) * (2 * DIM) + flat[other, s], minlength=len(total)), out=total)

        held, n, gap = [], 0, np.full(WINDOW, PAD, np.int32)
        for b in batches:
            for text in b["text"]:
                words = token_buckets(text)[0]
                for start in range(0, len(words), 1 << 20):  # a very long text goes in overlapping pieces
                    held += [words[start : start + (1 << 20)], gap]
                    n += min(1 << 20, len(words) - start)
                    if n >= 1 << 20:
                        add(np.concatenate(held))
                        held, n = [], 0
        if held:
            add(np.concatenate(held))
        sums = total.reshape(BUCKETS, DIM, 2)
        sums = (sums[:, :, 0] - sums[:, :, 1]).reshape(-1, PIECE * DIM)
        some = np.flatnonzero(sums.any(1))
        if len(some):
            yield pd.DataFrame({"piece": some.astype(np.int32), "sums": list(sums[some])})

    def join(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": part["piece"][:1], "sums": [np.sum(np.stack(part["sums"].to_list()), axis=0)]})

    schema = "piece int, sums array<long>"
    return docs.select("text").filter("text IS NOT NULL").mapInPandas(tally, schema).groupBy("piece").applyInPandas(join, schema)


class WordVectors:
    """Unit word vectors of the buckets, beside their index vectors; of a fixed size."""

    def __init__(self, pieces: list[tuple[int, list[int]]]):
        at, sign = index_vectors()
        index = np.zeros((BUCKETS, DIM), np.float32)
        np.put_along_axis(index, at, sign.astype(np.float32), 1)
        words = np.zeros((BUCKETS, DIM))
        for piece, sums in pieces:
            words[piece * PIECE : (piece + 1) * PIECE] = np.asarray(sums).reshape(-1, DIM)
        norm = np.linalg.norm(words, axis=1, keepdims=True)
        words = words / np.where(norm > 0, norm, 1)
        words[[CAPITALS, REPEAT]] = index[[CAPITALS, REPEAT]]
        self.table = np.hstack([words.astype(np.float32), index])

    def pool(self, text: str | None) -> np.ndarray:
        """The mean vector of a text; zeros without a word."""
        words, capitals = token_buckets(text)
        if not len(words):
            return np.zeros(2 * DIM, np.float32)
        counts = np.bincount(words, minlength=BUCKETS)
        counts[CAPITALS] = capitals
        counts[REPEAT] = int((words[1:] == words[:-1]).sum())
        some = np.flatnonzero(counts)
        return (counts[some].astype(np.float32) @ self.table[some]) / np.float32(len(words))


class Network:
    """Standardised inputs, one hidden layer of rectifiers, one output; a temperature divides its logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.temperature, self.bias = 1.0, None
        if len(y) == 0 or y.min() == y.max():  # nothing to tell apart: the smoothed rate of label 1
            rate = (y.sum() + 0.5) / (len(y) + 1.0)
            self.bias = float(np.log(rate / (1 - rate)))
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-4
        z = (x - self.mean) / self.scale
        fold = rng.permutation(len(y))
        check, train = fold[: len(y) // 5], fold[len(y) // 5 :]
        d = x.shape[1]
        self.p = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
                h = np.maximum(z[at] @ self.p[0] + self.p[1], 0)
                error = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -40, 40))) - y[at]) / max(1, len(at))
                back = np.outer(error, self.p[2]) * (h > 0)
                grads = [z[at].T @ back + DECAY * self.p[0], back.sum(0), h.T @ error + DECAY * self.p[2], error.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if len(check):
            logits, best = self._logits(z[check]), None
            for t in np.exp(np.linspace(-1.5, 3.0, 91)):
                s = np.clip(logits / t, -40, 40)
                loss = float(np.mean(np.log1p(np.exp(-s)) * y[check] + np.log1p(np.exp(s)) * (1 - y[check])))
                if best is None or loss < best[0]:
                    best = (loss, float(t))
            self.temperature = best[1]

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1 for each row."""
        if self.bias is not None:
            logits = np.full(len(x), self.bias)
        else:
            logits = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, divisor: int = 5, fold: int = 0, most: int = TRAIN_ROWS) -> tuple[WordVectors, Network]:
    """Word vectors of all ``docs`` and a network from at most ``most`` labelled rows outside the fold.

    Labels without an id or a quality are left out; of an id that ``labels`` repeats the mean counts.
    Ids may be of any type that can be ordered. An empty table teaches nothing.
    """
    vectors = WordVectors([tuple(r) for r in neighbour_sums(docs).collect()])
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(remainder(F.col("doc_id"), divisor) != fold)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), "y")

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [shared.value.pool(t) for t in b["text"]]})

    # at most ``most`` ids are broadcast; an id may repeat, and its least text counts, so at most ``most`` rows come back
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(pool, f"doc_id {kind}, y int, x array<float>").toPandas().sort_values("doc_id")
    x = np.stack(got["x"].to_list()).astype(np.float64) if len(got) else np.zeros((0, 2 * DIM))
    return vectors, Network(x, got["y"].to_numpy(np.float64))


def score_documents(docs: DataFrame, vectors: WordVectors, network: Network) -> tuple[DataFrame, str]:
    """All columns of ``docs`` with the calibrated probability of label 1, and its column's name: score, or _score and so on where the table has that.

    A null text is an empty one and has the score of the empty vector. Only text is read for the
    score. Repeated rows have equal scores; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        v, net = shared.value
        return pd.Series(net.score(np.stack([v.pool(t) for t in texts])) if len(texts) else np.zeros(0))

    name = free_name(docs.columns, "score")
    return docs.withColumn(name, score(F.col("text"))), name


def held_out_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, divisor: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; learns only from labels outside the fold.

    Without a label of each kind the score is the smoothed rate of label 1 for all.
    """
    found, _ = score_documents(docs.select("doc_id", "text"), *fit(docs, labels, divisor, fold))
    held = F.coalesce(remainder(F.col("doc_id"), divisor) == fold, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
