"""SimHash near-duplicate groups found with vantage-point trees.

Fingerprints (64 bits) link at ``radius`` or fewer differing bits. The search is exact:

* Equal fingerprints are collapsed first, so a group of copies is one point.
* By the pigeonhole principle two fingerprints within ``radius`` bits agree up to
  ``radius // BLOCKS`` bits on one of ``BLOCKS`` disjoint bit blocks. Each block has its own
  vantage-point tree over the Hamming distance on that block, where the search radius is so small
  that the triangle bounds prune most branches (over all 64 bits at once, distances concentrate
  and the bounds hardly prune).
* The top of each tree is fitted on a bounded sample and shards the points: a point is indexed in
  one shard and asks every shard that its ball overlaps. Shards over a size limit become a grid of
  index chunks and query chunks, so no task holds an unbounded shard.
* A task continues the tree inside its cell, compares what is left exactly on all 64 bits, and
  returns a spanning star of each local component instead of all pairs, so a large group of near
  copies costs a row a member. Components then join the stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegraph.llm.tables import BROADCAST_ROWS, located, most_frequent, own_columns, place, text_slices, without
from quotegraph.operators.components import connected_components
from quotegraph.plans.shared import forget, materialize

RADIUS, SHINGLE, SEED, BLOCKS = 4, 4, 42, 3
#: Points that a shard should index; points that fit the trees, of a shard and at most; rows of a grid chunk.
SHARD_POINTS, SAMPLE_SHARD, SAMPLE_POINTS, INDEX_CHUNK, QUERY_CHUNK = 4096, 64, 1 << 20, 1 << 16, 1 << 18
LEAF, MAX_DEPTH = 192, 17
#: Shared shingles (8 bytes) and pairs of sets (16 bytes) that may be broadcast; characters of texts that are hashed at once.
BROADCAST_SHINGLES, BROADCAST_PAIRS, SLICE = 2_000_000, 500_000, 1 << 21
#: Near-dedup: words of a shingle, least Jaccard similarity; shingles that come last in the order of prefixes, and from how many rows on.
NEAR_SHINGLE, NEAR_SIMILARITY, COMMON_SHINGLES, COMMON_SEEN = 5, 0.8, 100_000, 16
#: Near-dedup: shingles of two sets for which one more must be shared first.
FIRST_SHARED = 400
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of the A-Z lower-cased text; fewer words give one shingle."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_SPACE)
    words = data.split(b" ") if b"  " not in data else [w for w in data.split(b" ") if w]
    if words and not (words[0] and words[-1]):
        words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.flatnonzero(np.frombuffer(joined + b" ", np.uint8) == 32)
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if more than half of the shingle hashes have it; no words give 0. Unsigned."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 of none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _block_masks(blocks: int) -> np.ndarray:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])], np.uint64)


def distance(points: np.ndarray, centre: np.uint64, mask: np.uint64) -> np.ndarray:
    """Hamming distance to ``centre`` over the bits of ``mask``."""
    return np.bitwise_count((points ^ centre) & mask)


def _vantage(points: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int]:
    """The candidate that sees the widest spread, and its median distance."""
    best, spread, cut = points[0], -1.0, 64
    for centre in points[:: max(1, len(points) // 5)][:5]:
        d = distance(points, centre, mask)
        low, high = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]), int(d.max())
        width = float(d.std()) if low < high else -0.5
        if width > spread:
            best, spread, cut = centre, width, low
    return best, cut


class VantageTree:
    """The top ``depth`` levels of a vantage-point tree, as a heap: children of i are 2i+1 (inside), 2i+2."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, depth: int):
        n = (1 << depth) - 1
        self.mask, self.depth, self.centres, self.cuts = mask, depth, np.zeros(n, np.uint64), np.full(n, 64, np.int64)
        parts = {0: sample}
        for node in range(n):
            points = parts.pop(node)
            if len(points):
                self.centres[node], self.cuts[node] = _vantage(points, mask)
            near = distance(points, self.centres[node], mask) <= self.cuts[node]
            parts[2 * node + 1], parts[2 * node + 2] = points[near], points[~near]

    def home(self, points: np.ndarray) -> np.ndarray:
        """The shard that indexes each point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.bitwise_count((points ^ self.centres[node]) & self.mask) > self.cuts[node])
        return node - ((1 << self.depth) - 1)

    def reached(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """``(row, shard)`` of every shard that a point's ball of ``radius`` overlaps."""
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count((points[row] ^ self.centres[node]) & self.mask).astype(np.int64)
            inside, outside = d - radius <= self.cuts[node], d + radius > self.cuts[node]
            row, node = np.concatenate((row[inside], row[outside])), np.concatenate((2 * node[inside] + 1, 2 * node[outside] + 2))
        return row, node - ((1 << self.depth) - 1)


class _Forest:
    """Labels of points; a label is the least index of its component so far."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            if np.array_equal(up, at):
                return at
            at = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            keep = a != b
            a, b = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
            np.minimum.at(self.parent, b, a)


def _compare(points: np.ndarray, index: np.ndarray, asks: np.ndarray, radius: int, forest: _Forest) -> None:
    """Links asked and indexed points by brute force; later blocks skip what is linked already."""
    at, step, most = 0, 16, max(16, (1 << 21) // max(1, len(asks)))
    asked = points[asks]
    while at < len(index):
        rows = index[at : at + step]
        i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ asked[None, :]) <= radius)
        a, b = forest.roots(rows)[i], forest.roots(asks)[j]
        if len(a := a[keep := a != b]):
            forest.link(a, b[keep])
        at, step = at + step, min(step * 4, most)


def link_cell(points: np.ndarray, index: np.ndarray, asks: np.ndarray, mask: np.uint64, block_radius: int, radius: int, forest: _Forest) -> None:
    """Continues the tree below a cell. ``index`` and ``asks`` are positions in ``points``."""
    todo = [(index, asks, mask, block_radius)]
    while todo:
        index, asks, mask, r = todo.pop()
        if not len(index) or not len(asks):
            continue
        if len(index) <= LEAF or len(asks) <= 8:
            _compare(points, index, asks, radius, forest)
            continue
        centre, cut = _vantage(points[index], mask)
        d = distance(points[index], centre, mask)
        near = d <= cut
        if near.all():
            if mask == ~np.uint64(0):
                _compare(points, index, asks, radius, forest)
            else:  # the block can't tell them apart: go on with the distance over all bits
                todo.append((index, asks, ~np.uint64(0), radius))
            continue
        q = distance(points[asks], centre, mask).astype(np.int64)
        todo += [(index[near], asks[q - r <= cut], mask, r), (index[~near], asks[q + r > cut], mask, r)]


def _fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": _signed([fingerprint(t) for t in b.column("text").to_pylist()])})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(unsigned: list[int]) -> np.ndarray:
    return np.array(unsigned, np.uint64).view(np.int64)


def _cells(points: DataFrame, trees: list[VantageTree], block_radius: int) -> DataFrame:
    """Index and query rows of each cell; a cell over the chunk limits becomes a grid."""
    shards = 1 << trees[0].depth

    def places(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for t, tree in enumerate(trees):
            yield 0, np.arange(len(fp)), t * shards + tree.home(fp)
            row, shard = tree.reached(fp, block_radius)
            yield 1, row, t * shards + shard

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, len(trees) * shards), np.int64)
        for b in batches:
            for role, _, cell in places(b["fp"].to_numpy().view(np.uint64)):
                totals[role] += np.bincount(cell, minlength=totals.shape[1])
        role, cell = np.nonzero(totals)
        yield pd.DataFrame({"role": role.astype(np.int32), "cell": cell.astype(np.int32), "n": totals[role, cell]})

    # one row for each shard and role, so bounded by the trees' size
    chunks = np.ones((2, len(trees) * shards), np.int64)
    for role, cell, n in points.select("fp").mapInPandas(tally, "role int, cell int, n long").groupBy("role", "cell").agg(F.sum("n")).collect():
        chunks[role, cell] = ceil(n / (QUERY_CHUNK if role else INDEX_CHUNK))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(fps), 1 << 14):
                fp = fps[at : at + (1 << 14)]
                spread = fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for role, row, cell in places(fp):
                    own, other = chunks[role, cell], chunks[1 - role, cell]
                    pick = spread[row].astype(np.int64) % own
                    repeat = np.repeat(np.arange(len(row)), other)
                    turn = np.arange(len(repeat)) - np.repeat(np.cumsum(other) - other, other)
                    pick = pick[repeat]
                    yield pd.DataFrame({"cell": cell[repeat].astype(np.int32), "ichunk": (turn if role else pick).astype(np.int32), "qchunk": (pick if role else turn).astype(np.int32), "role": np.full(len(repeat), role, np.int32), "fp": fp[row][repeat].view(np.int64)})

    return points.select("fp").mapInPandas(deal, "cell int, ichunk int, qchunk int, role int, fp long")


def hamming_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(src, dst)`` links that span the components of the graph of all pairs within ``radius`` bits.

    ``points`` has distinct non-null ``fp`` longs in a written table. No pair is lost: two points
    are in one component of these links exactly if they are in one component of all pairs.
    """
    spark = points.sparkSession
    n = points.count()
    masks, block_radius = _block_masks(BLOCKS), radius // BLOCKS
    depth = max(0, min(MAX_DEPTH, ceil(log2(max(1, n) / SHARD_POINTS))))
    share = min(ceil(n / 8), SAMPLE_SHARD << depth, SAMPLE_POINTS) / max(1, n)  # a sample by hash: what it is only changes how even shards are
    rows = points.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("fp").toPandas()
    sample = np.sort(rows["fp"].to_numpy(np.int64).view(np.uint64))
    depth = min(depth, max(0, int(log2(max(1, len(sample)) / 8))))
    trees = [VantageTree(sample, m, depth) for m in masks]

    def search(key, cell: pd.DataFrame) -> pd.DataFrame:
        fp, at = np.unique(cell["fp"].to_numpy().view(np.uint64), return_inverse=True)
        asks = cell["role"].to_numpy() == 1
        forest = _Forest(len(fp))
        link_cell(fp, np.unique(at[~asks]), np.unique(at[asks]), masks[key[0] >> depth], block_radius, radius, forest)
        roots = forest.roots(np.arange(len(fp)))
        moved = np.flatnonzero(roots != np.arange(len(fp)))
        return pd.DataFrame({"src": fp[moved].view(np.int64), "dst": fp[roots[moved]].view(np.int64)})

    return _cells(points, trees, block_radius).groupBy("cell", "ichunk", "qchunk").applyInPandas(search, "src long, dst long")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has fingerprint zero and links like any other. component_id is the least
    non-null doc_id of the group of fingerprints reachable over links; null only if none has an
    id. Repeated rows give repeated results. An empty table gives an empty result. Ids may be of any
    type that can be ordered.
    """
    prints = materialize(_fingerprints(docs), "simhash-prints")
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-points")
    links = materialize(hamming_links(points, radius), "simhash-links")
    found = materialize(connected_components(links), "simhash-components")
    rooted = materialize(points.join(found, points.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root")), "simhash-rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    for done in (points, links, found, rooted, least):
        forget(done)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _measured(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Of located ``docs`` one row for each of theirs, (doc_id, _file, _row, set, fp, n): a hash of its set of ``n`` shingles and its
    fingerprint; and (h, n) of shingles that some SLICE characters of texts have more than once. Texts are walked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in text_slices(b.column("text"), SLICE):
                found = [np.unique(shingle_hashes(t, shingle)) for t in texts]
                own = {c: b.column(c).slice(at, len(texts)) for c in ("doc_id", "_file", "_row")}
                yield pa.RecordBatch.from_pydict(own | {"set": _signed([set_name(h) for h in found]), "fp": _signed([majority(h) for h in found]), "n": [len(h) for h in found], "repeat": pa.array([False] * len(found))})
                h, n = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
                h, n = h[n > 1].view(np.int64), n[n > 1]
                yield pa.RecordBatch.from_pydict({c: pa.nulls(len(h), x.type) for c, x in own.items()} | {"set": h, "fp": h, "n": n.astype(np.int64), "repeat": pa.array([True] * len(h), pa.bool_())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.select("doc_id", "_file", "_row", "text").mapInArrow(run, f"doc_id {kind}, _file string, _row long, set long, fp long, n long, repeat boolean")
    both = materialize(both, "near-measured")
    return both.filter("NOT repeat").drop("repeat"), both.filter("repeat").select(F.col("set").alias("h"), "n")


def set_name(hashes: np.ndarray) -> int:
    """A hash of a set of shingle hashes, by which equal sets are one."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)


class _Texts:
    """The texts of located documents by the sets of their shingles."""

    def __init__(self, docs: DataFrame, file: str, row: str, measured: DataFrame, sets: DataFrame):
        self.docs, self.file, self.row, self.measured, self.sets = docs.select(file, row, "text"), file, row, measured, sets

    def one_each(self) -> DataFrame:
        """``(text)``: one row of each set; the others of equal sets are left out by their locators."""
        firsts = self.sets.select(F.col("keeper.file").alias("_file"), F.col("keeper.row").alias("_row"))
        return without(self.docs, self.measured.join(firsts, ["_file", "_row"], "left_anti"), self.file, self.row).select("text")

    def of(self, asked: DataFrame) -> DataFrame:
        """``(set, text)`` of the sets of ``asked`` (set)."""
        at = asked.join(self.sets, "set").select("set", F.col("keeper.file").alias(self.file), F.col("keeper.row").alias(self.row))
        at = materialize(at, "near-asked")
        return self.docs.join(F.broadcast(at) if at.count() <= BROADCAST_ROWS else at, [self.file, self.row]).select("set", "text")


def _hash_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``(set, hashes)`` of ``texts`` (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in text_slices(b.column("text"), SLICE):
                found = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in part]
                ends = np.concatenate(([0], np.cumsum([len(h) for h in found], dtype=np.int64)))
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate([*found, np.empty(0, np.int64)]))
                yield pa.RecordBatch.from_pydict({"set": b.column("set").slice(at, len(part)), "hashes": lists})

    return texts.mapInArrow(run, "set long, hashes array<long>")


def _prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float) -> DataFrame:
    """``(h, set, n, at)``: the first shingles of the set of each of ``texts`` (text), ``n`` in all, and the place of each from 0.

    So many that sets of this Jaccard similarity share one. ``common`` has shingles that come last,
    and about how often each occurs; they only set an order, so what they are loses no pair.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for b in batches:
            for _, part in text_slices(b.column("text"), SLICE):
                firsts, names, sizes = [np.empty(0, np.int64)], [], []
                for text in part:
                    h = np.unique(shingle_hashes(text, shingle)).view(np.int64)
                    if not (n := len(h)):
                        continue
                    names.append(set_name(h))
                    sizes.append(n)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        h = h[np.lexsort((h, np.where(known[at] == h, often[at], 0)))]
                    firsts.append(h[: _prefix(n, similarity)])
                many = [len(x) for x in firsts[1:]]
                places = np.concatenate([np.empty(0, np.int32), *(np.arange(k, dtype=np.int32) for k in many)])
                yield pa.RecordBatch.from_pydict({"h": np.concatenate(firsts), "set": np.repeat(_signed(names), many), "n": np.repeat(np.array(sizes, np.int32), many), "at": places})

    return texts.mapInArrow(run, "h long, set long, n int, at int")


def _prefix(n: int, similarity: float) -> int:
    """How many first shingles of ``n`` two sets of this similarity must share one of."""
    return n - ceil(similarity * n - 1e-9) + 1


def _asked(n: Column, m: Column, similarity: float) -> tuple[Column, Column]:
    """What sets of ``n`` and ``m`` shingles share at least if they are similar, and how many of it to look for among their first ones.

    One suffices; of large sets some more are asked for, so that a passage alone costs no comparison.
    """
    least = F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-6)
    among = least - F.ceil(similarity * F.greatest(n, m) - 1e-9) + 1  # of the shared ones that prefixes hold
    return least, F.greatest(F.lit(1), F.least(among, 1 + F.floor((n + m) / FIRST_SHARED)))


def _may_meet(n: Column, i: Column, m: Column, j: Column, similarity: float) -> Column:
    """Whether a shingle at places ``i`` and ``j`` of sets of ``n`` and ``m`` counts towards what a similar pair shares first.

    Similar sets share ``least`` shingles or more, so k of them among the first n - least + k and
    m - least + k of each. They share no more than those before one, itself, and those behind it.
    """
    least, k = _asked(n, m, similarity)
    return (F.least(n, m) >= least) & (n - i + k > least) & (m - j + k > least) & (F.least(i, j) + F.least(n - i, m - j) >= least)


def _similar(pairs: DataFrame, texts: _Texts, shingle: int, similarity: float) -> DataFrame:
    """The distinct ``pairs`` (src, dst) of sets whose exact Jaccard similarity reaches the bound."""
    pairs = materialize(pairs, "near-pairs")
    asked = pairs.select(F.explode(F.array("src", "dst")).alias("set")).distinct()
    own = materialize(_hash_sets(texts.of(asked), shingle), "near-hashes")
    side = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    both = own.toDF("src", "_a").join(side, "src").join(own.toDF("dst", "_b"), "dst")
    shared = F.size(F.array_intersect("_a", "_b"))
    found = materialize(both.filter(shared / (F.size("_a") + F.size("_b") - shared) >= similarity).select("src", "dst"), "near-similar")
    forget(own)
    return found


def _blocks(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (h, set, n, at) whose shingle another set has too. Hashes alone are counted; most are seen once and go."""
    more = materialize(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1").select("h"), "near-shared")
    blocks = materialize(keyed.join(F.broadcast(more) if more.count() <= BROADCAST_SHINGLES else more, "h", "left_semi"), "near-blocks")
    forget(more)
    forget(keyed)
    return blocks


def similar_links(sets: DataFrame, texts: _Texts, common: tuple[np.ndarray, np.ndarray], shingle: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``(src, dst)`` links that span the components of the graph of all ``sets`` (set, fp) within ``similarity``.

    First the vantage-point trees: sets of one fingerprint, and of fingerprints within ``radius``
    bits, are compared exactly. So far apart as ``similarity`` allows, fingerprints lie where no
    tree prunes (some 10 of 64 bits at 0.8), so prefix filtering finds the rest: in any one order of
    all shingles, two sets of Jaccard similarity s share a shingle among the first
    n - ceil(s n) + 1 of each. Common shingles come last, so a common line makes no block. In a block
    each set is compared with a leader of its size and the one of the size below: the set that has
    the shingle first, so has the fewest of its own before it. Of a large group of near copies that
    is one near the middle, which most others reach, so a group is linked by a few pairs a member
    even where most of its pairs are not similar. Then those pairs of a block that aren't yet in one
    component are compared; the members of its largest part don't meet each other.

    Pairs that can't be similar aren't compared (``_may_meet``): a pair is met only within the first
    shingles that its two sizes ask for, some n/9 for equal sizes where prefixes have n/5.
    """
    first = materialize(sets.groupBy("fp").agg(F.min("set").alias("first")), "near-points")
    close = hamming_links(first.select("fp"), radius)
    same = sets.join(first, "fp").filter("set <> first").select(F.col("first").alias("src"), F.col("set").alias("dst"))
    ends = [first.select(F.col("fp").alias(a), F.col("first").alias(b)) for a, b in (("src", "_a"), ("dst", "_b"))]
    near = close.join(ends[0], "src").join(ends[1], "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))

    blocks = _blocks(materialize(_prefixes(texts.one_each(), common, shingle, similarity), "near-prefixes"))
    sized = blocks.withColumn("_size", F.floor(F.log(F.col("n").cast("double")) / -log(min(similarity, 0.99))).cast("int"))  # similar sets are of one size or neighbours
    lead = materialize(sized.groupBy("h", "_size").agg(F.min(F.struct("at", "set", "n")).alias("lead")), "near-leads")
    n, i, m, j = (F.col(c) for c in ("n", "at", "m", "_at"))
    leads = lead.select("h", F.explode(F.array("_size", F.col("_size") + 1)).alias("_size"), F.col("lead.set").alias("_lead"), F.col("lead.n").alias("m"), F.col("lead.at").alias("_at"))
    met = sized.join(leads, ["h", "_size"]).filter((F.col("set") != F.col("_lead")) & _may_meet(n, i, m, j, similarity))
    met = met.groupBy(F.col("_lead").alias("src"), F.col("set").alias("dst"), "n", "m").agg(F.count(F.lit(1)).alias("c"))
    met = met.filter(2 * F.col("c") >= _asked(n, m, similarity)[1]).select("src", "dst")  # not all that they share
    star = _similar(same.unionByName(near).unionByName(met).distinct(), texts, shingle, similarity)

    parts = materialize(connected_components(star), "near-parts")
    placed = materialize(blocks.join(parts, blocks["set"] == parts["node"], "left").select("h", "set", "n", "at", F.coalesce("component", "set").alias("part")), "near-placed")
    tally = placed.groupBy("h", "part").agg(F.count(F.lit(1)).alias("_many"))
    split = tally.groupBy("h").agg(F.max_by("part", F.struct("_many", "part")).alias("_main"), F.count(F.lit(1)).alias("_parts")).filter("_parts > 1")
    open_ = materialize(placed.join(split, "h").select("h", "set", "n", "at", "part", (F.col("part") == F.col("_main")).alias("main")), "near-open")
    for done in (placed, blocks, lead, first):
        forget(done)
    a = open_.filter("NOT main").drop("main").toDF("h", "src", "n", "at", "_p")
    b = open_.toDF("h", "dst", "m", "_at", "_q", "_main")
    rest = a.join(b, (a["h"] == b["h"]) & (a["_p"] != b["_q"]) & (b["_main"] | (a["src"] < b["dst"])) & _may_meet(n, i, m, j, similarity))
    rest = rest.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count(F.lit(1)).alias("c"), F.min(_asked(n, m, similarity)[1]).alias("k"))
    rest = rest.filter("c >= k").select("src", "dst")
    return star.unionByName(_similar(rest, texts, shingle, similarity))


def near_dedup(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """Keeps one row of each group of near copies, with all its columns, extra ones of any name too.

    Rows link if the sets of their word shingles have this Jaccard similarity or more, which is
    compared exactly; texts without words (null, empty, blank) are equal. Of a group the row with
    the least (doc_id, locator) stays, an id before null, so rows that repeat an id or have none
    count by their texts. An empty table gives an empty result.
    """
    whole, file, row = located(docs, "near-source")
    measured, repeats = _measured(whole.select("doc_id", F.col(file).alias("_file"), F.col(row).alias("_row"), "text"), shingle)
    sets = materialize(measured.groupBy("set").agg(F.min(place()).alias("keeper"), F.first("fp").alias("fp"), F.first("n").alias("n")), "near-sets")
    common = sorted(most_frequent(repeats.groupBy("h").agg(F.sum("n").alias("n")), COMMON_SEEN, COMMON_SHINGLES))
    common = np.array([x[0] for x in common], np.int64), np.array([x[1] for x in common], np.int64)
    texts = _Texts(whole, file, row, measured, sets)
    found = materialize(connected_components(similar_links(sets.filter("n > 0").select("set", "fp"), texts, common, shingle, similarity)), "near-components")
    keep = sets.join(found, sets["set"] == found["node"], "left").groupBy(F.coalesce("component", "set").alias("root")).agg(F.min("keeper").alias("keeper"))
    keep = materialize(keep.select(F.col("keeper.file").alias("_file"), F.col("keeper.row").alias("_row")), "near-keep")
    gone = measured.select("_file", "_row").join(keep, ["_file", "_row"], "left_anti")
    return without(whole, gone, file, row).select(*own_columns(docs))


def hex16(fp):
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
