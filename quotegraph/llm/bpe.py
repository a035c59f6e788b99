"""BPE encoding and decoding over a minimal acyclic transducer.

Frequent words are compiled with their token ids into a minimal acyclic transducer: words share
prefixes and suffixes, arc outputs add up to a word's ordinal, and the ordinal finds its ids. The
file is written once, shipped to each executor by Spark and memory-mapped by its Python workers, so
workers of a machine share its pages. A word that the transducer lacks is merged exactly by the
merge ranks, so which words count as frequent never changes a result.

Normalising, splitting and byte mapping follow the tokenizer file's own parts: NFC, lower case
character by character, the split pattern, the byte alphabet and the word-end suffix. No word holds
white space, so texts are cut at spaces first; Arrow finds the distinct chunks of a slice of texts,
each is encoded once, and Arrow joins the results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import string
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegraph.llm.tables import most_frequent, ship, text_slices

#: The lexicon: words seen at least MIN_COUNT times in all documents, the MAX_WORDS most frequent at most.
MIN_COUNT, MAX_WORDS = 8, 1 << 17
#: Characters of a word that the lexicon may have, and bytes of one that is merged among many at a time.
WORD_LENGTH, MERGED_BYTES = 64, 64
#: Characters of the texts of a slice (a longer text is a slice of its own), and distinct chunks that a task counts before it emits them.
SLICE, TALLY_CHUNKS = 1 << 21, 200_000
_MAGIC = b"QGMAT002"

# The tokenizer library's letters and digits are those of Unicode 16.0. These came later.
LATER_LETTERS = (
    0x558, (0x58B, 0x58C), 0x88F, 0xC5C, 0xCDC, 0x208F, (0x209D, 0x209F), (0xA7CE, 0xA7CF), 0xA7DD, 0xA7E2, 0xA7F1, (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), 0x11B0A, (0x11DB0, 0x11DDB), 0x11DF1,
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), 0x1B168, 0x1D6A6, (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), 0x2B81E, (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LATER_NUMBERS = ((0x11DE0, 0x11DE9), 0x1246F, (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
# Its lower case is newer than that of Python's tables. Capitals, and how far the small letter is.
LATER_CAPITALS = ((0x1C89, 1), (0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 1), (0xA7CE, 1), (0xA7D2, 1), (0xA7D4, 1), (0xA7DA, 1), (0xA7DC, 0x19B - 0xA7DC), *((c, 32) for c in range(0x10D50, 0x10D66)), *((c, 27) for c in range(0x16EA0, 0x16EB9)))
# Its NFC is that of Unicode 9.0, which doesn't know these marks: nothing moves over them or joins with them.
LATER_MARKS = (
    0x7FD, (0x898, 0x89F), (0x8CA, 0x8D3), 0x9FE, 0xC3C, (0xD3B, 0xD3C), 0xEBA, 0x1715, (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), 0xA82C,
    (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), 0x11070, 0x1133B, 0x1145E,
    (0x11839, 0x1183A), 0x11930, (0x1193D, 0x1193E), 0x11943, 0x119E0, 0x11A34, 0x11A47, 0x11A99, 0x11D42, (0x11D44, 0x11D45), 0x11D97,
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), 0x1E08F, (0x1E130, 0x1E136), 0x1E2AE, (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)


def _span(ranges: tuple) -> str:
    """Code points and ranges of them as the inside of a character set."""
    return "".join(chr(r) if isinstance(r, int) else f"{chr(r[0])}-{chr(r[1])}" for r in ranges)


_MARKS = regex.compile(f"([{_span(LATER_MARKS)}])")
_LOWER = {c: c + far for c, far in LATER_CAPITALS}
_NEVER, _ASCII_MARKS = 1 << 62, frozenset(string.punctuation)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


class Vocabulary:
    """The parts of a tokenizer file that encoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.specials.items()}
        self.size = max(self.tokens) + 1
        alphabet = byte_alphabet()
        #: Ids of each byte's token within a word and at its end.
        self.inner, self.last = np.array([ids[c] for c in alphabet]), np.array([ids[c + suffix] for c in alphabet])
        # a pair of ids as one number, and for it the rank and the id of what it merges to, as one number
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = {ids[a] * self.size + ids[b]: rank * self.size + ids[a + b] for rank, (a, b) in enumerate(merges)}
        self._fill_table()
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # \s is White_Space here; in the regex module it has four control characters more
        letters, numbers = (rf"[\p{{{kind}}}--[{_span(later)}]]" for kind, later in (("L", LATER_LETTERS), ("N", LATER_NUMBERS)))
        self.words = regex.compile(split.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", r"\p{White_Space}"), regex.V1)
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.marker = os.path.commonprefix(list(self.specials))

    def normalise(self, text: str) -> str:
        """A text without special tokens, composed and in lower case; a line's end is a space."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = "".join(unicodedata.normalize("NFC", x) for x in _MARKS.split(text))
            text = text.replace("Σ", "σ")
        return text.lower().replace("\n", " ")

    def split(self, chunk: str) -> list[str]:
        """The words of a normalised text."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in _ASCII_MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.words.findall(chunk if chunk.isascii() else chunk.translate(_LOWER))

    def _fill_table(self) -> None:
        """The pairs as an open-addressing table, at most an eighth full, for lookups of many at once."""
        bits = max(4, (8 * len(self.pairs)).bit_length())
        self.shift, self.keys, self.values = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NEVER, np.int64)
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        for key, at in zip(keys.tolist(), self._slot(keys).tolist()):
            while self.keys[at] >= 0:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.values[at] = key, self.pairs[key]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of ids what ``pairs`` has; a number above all without one."""
        keys = a * self.size + b
        at = self._slot(keys)
        found, out = self.keys[at], self.values[at]
        far = np.nonzero((found != keys) & (found >= 0))
        while len(far[0]):
            at[far] = (at[far] + 1) & (len(self.keys) - 1)
            found[far], out[far] = self.keys[at[far]], self.values[at[far]]
            far = tuple(x[(found[far] != keys[far]) & (found[far] >= 0)] for x in far)
        out[found != keys] = _NEVER
        return out

    def merge(self, word: str) -> list[int]:
        """The ids of a word by its merge ranks: the lowest rank first, the leftmost of equal ones."""
        *data, end = word.encode("utf-8", "surrogatepass")
        return self._merge_long([*map(self.inner.tolist().__getitem__, data), int(self.last[end])])

    def merge_many(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`merge` for words of one length in bytes, as rows of ``data``: (rows, their ids) for each number of ids.

        Each round merges one pair in every row, so rows keep one width, and those without a pair leave.
        """
        rows, ids = np.arange(len(data)), self.inner[data]
        ids[:, -1] = self.last[data[:, -1]]
        ranks = self.ranked(ids[:, :-1].copy(), ids[:, 1:].copy())
        while len(rows) and ids.shape[1] > 1:
            at = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), at]
            if (done := low == _NEVER).any():
                yield rows[done], ids[done]
                rows, ids, ranks, at, low = rows[~done], ids[~done], ranks[~done], at[~done], low[~done]
            every, width = np.arange(len(rows)), ids.shape[1] - 1
            place = np.arange(width)
            ids = np.where(place <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[every, at] = own = low % self.size
            ranks = np.where(place[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.ranked(ids[some, at[some] - 1], own[some])
            some = np.flatnonzero(at < width - 1)
            ranks[some, at[some]] = self.ranked(own[some], ids[some, at[some] + 1])
        if len(rows):
            yield rows, ids

    def _merge_long(self, parts: list[int]) -> list[int]:
        """Merges with a heap, in O(n log n)."""
        n, get, size = len(parts), self.pairs.get, self.size
        parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(low, i, parts[i], parts[i + 1]) for i in range(n - 1) if (low := get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = low % size, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (low := get(parts[p] * size + parts[q])) is not None:
                    heapq.heappush(heap, (low, p, parts[p], parts[q]))
        return [parts[i] for i in range(n) if not gone[i]]


class _State:
    __slots__ = ("final", "arcs", "number", "words")

    def __init__(self):
        self.final, self.arcs, self.number, self.words = False, {}, -1, 0

    def key(self) -> tuple:
        return self.final, tuple((c, id(s)) for c, s in self.arcs.items())


def compile_transducer(entries: dict[str, list[int]]) -> bytes:
    """A minimal acyclic transducer from words (UTF-8) to ids, as a file that can be mapped.

    Words are added in byte order; the part of the last word that no later word can change is
    merged with equal states as soon as it is left behind.
    """
    words = sorted((w.encode("utf-8", "surrogatepass"), w) for w in entries)
    root, register, path, last = _State(), {}, [], b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            parent.arcs[label] = register.setdefault(child.key(), child)

    for data, _ in words:
        common = len(os.path.commonprefix([data, last]))
        settle(common)
        at = path[-1][2] if path else root
        for label in data[common:]:
            child = _State()
            at.arcs[label] = child
            path.append((at, label, child))
            at = child
        at.final, last = True, data
    settle(0)

    order: list[_State] = []

    def visit(top: _State) -> None:  # children come before their parents
        stack = [(top, False)]
        while stack:
            state, ready = stack.pop()
            if state.number >= 0:
                continue
            if ready:
                state.number, state.words = len(order), int(state.final) + sum(s.words for s in state.arcs.values())
                order.append(state)
            else:
                stack.append((state, True))
                stack += [(s, False) for s in state.arcs.values() if s.number < 0]

    visit(root)
    keys, target, output = [], [], []
    for state in order:
        skipped = int(state.final)
        for label, child in sorted(state.arcs.items()):
            keys.append(state.number << 8 | label)
            target.append(child.number)
            output.append(skipped)
            skipped += child.words
    ids = [entries[w] for _, w in words]
    offsets = np.cumsum([0] + [len(x) for x in ids])
    parts = [np.array(x, np.uint32) for x in (keys, target, output, offsets, [i for x in ids for i in x])] + [np.array([s.final for s in order], np.uint8)]
    head = struct.pack("<8sIIII", _MAGIC, len(order), len(keys), len(ids), int(offsets[-1]))
    return head + b"".join(p.tobytes() for p in parts)


class Transducer:
    """A mapped transducer file. An arc's key is its state and label; keys rise, so arcs are found by bisection."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, arcs, words, ids = struct.unpack_from("<8sIIII", self.map)
        if magic != _MAGIC:
            raise ValueError(f"{path} is no transducer file")
        at, parts = 24, []
        for n, kind in ((arcs, np.uint32), (arcs, np.uint32), (arcs, np.uint32), (words + 1, np.uint32), (ids, np.uint32), (states, np.uint8)):
            parts.append(np.frombuffer(self.map, kind, n, at))
            at += parts[-1].nbytes
        self.keys, self.target, self.output, self.offsets, self.ids, self.final = parts
        self.root = states - 1

    def ordinals(self, data: np.ndarray) -> np.ndarray:
        """The ordinal of each word, all of one length in bytes, as rows of ``data``; -1 for words that it lacks."""
        out = np.full(len(data), -1)
        if not len(self.keys):
            return out
        rows, state, ordinal = np.arange(len(data)), np.full(len(data), self.root, np.uint32), np.zeros(len(data), np.int64)
        for label in data.T:
            key = state << 8 | label[rows]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            rows, arc = rows[hit], arc[hit]
            state, ordinal = self.target[arc], ordinal[hit] + self.output[arc]
        hit = self.final[state] == 1
        out[rows[hit]] = ordinal[hit]
        return out

    def get(self, word: str) -> list[int] | None:
        """The ids of one word, or None."""
        data = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
        at = int(self.ordinals(data[None])[0])
        return None if at < 0 else self.ids[self.offsets[at] : self.offsets[at + 1]].tolist()


def strings(texts: pa.Array) -> list[str]:
    """As Python strings; many times as fast as ``to_pylist``."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def chunks(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The normalised chunks of all texts, one after another, and the number of each text's.

    A special token is a chunk of its own behind a space, which no other chunk has.
    """
    odd = {} if not vocabulary.cut else {i: t for i, t in enumerate(texts) if t and vocabulary.marker in t and vocabulary.cut.search(t)}
    lists = pc.split_pattern(pa.array(["" if not t or i in odd else vocabulary.normalise(t) for i, t in enumerate(texts)], pa.large_string()), " ")
    flat, ends = lists.values, lists.offsets.to_numpy().astype(np.int64)
    some = pc.not_equal(flat, "")
    counts = np.diff(np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))[ends])
    flat = flat.filter(some)
    if odd:
        parts, starts, at = [], np.concatenate(([0], np.cumsum(counts))), 0
        for i, text in odd.items():
            own, last = [], 0
            for m in vocabulary.cut.finditer(text):
                own += [*vocabulary.normalise(text[last : m.start()]).split(" "), " " + m[0]]
                last = m.end()
            own = [c for c in (*own, *vocabulary.normalise(text[last:]).split(" ")) if c]
            parts += [flat.slice(at, starts[i] - at), pa.array(own, pa.large_string())]
            at, counts[i] = starts[i], len(own)
        flat = pa.concat_arrays([*parts, flat.slice(at)])
    return flat, counts


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run of ``size``, one run after another."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class Joined:
    """Runs of strings that each end in a space, each run as one text without its last space; nothing is copied."""

    def __init__(self, parts: pa.Array, starts: np.ndarray):
        _, offsets, self.data = parts.buffers()
        self.at = np.frombuffer(offsets, np.int64, len(parts) + 1)[starts] if len(parts) else np.zeros(len(starts), np.int64)

    def digests(self) -> list[str]:
        data, sha256 = memoryview(self.data or b""), hashlib.sha256
        return [sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(self.at.tolist(), self.at[1:].tolist())]

    def texts(self) -> pa.Array:
        whole = pa.LargeStringArray.from_buffers(len(self.at) - 1, pa.py_buffer(self.at), self.data or pa.py_buffer(b""))
        return pc.ascii_rtrim(whole, " ")


@dataclass
class Encoded:
    """A slice's results, one for each text: number of tokens, ids in decimal, decoded text, and an Arrow array of ids."""

    n_tokens: np.ndarray
    ids_text: Joined
    decoded: Joined
    ids: pa.Array


class Encoder:
    """Encodes and decodes as the tokenizer file says, with its lexicon if there is one."""

    def __init__(self, vocabulary: str, lexicon: str | None = None):
        self.vocabulary = v = Vocabulary(vocabulary)
        self.lexicon, self.merged = Transducer(lexicon) if lexicon else None, 0
        self.names = [pa.array([name(i) + " " for i in range(v.size)], pa.large_string()) for name in (str, lambda i: v.tokens.get(i, ""))]

    def word_ids(self, words: pa.Array) -> pa.Array:
        """The ids of each of the distinct ``words``: from the transducer, else by merging; a space marks a special token."""
        _, offsets, data = words.buffers()
        starts = np.frombuffer(offsets, np.int64, len(words) + 1)
        data, lengths = np.frombuffer(data or b"", np.uint8), np.diff(starts)
        rows, ids, sizes = [], [], []

        def add(own: np.ndarray, found: np.ndarray, size) -> None:
            rows.append(own)
            ids.append(found)
            sizes.append(np.broadcast_to(size, len(own)))

        order = np.argsort(lengths, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            n, spaced = int(lengths[own[0]]), data[starts[own]] == 32
            for i in [*own[spaced].tolist(), *(own[~spaced].tolist() if n > MERGED_BYTES else ())]:
                word = words[i].as_py()
                found = [self.vocabulary.specials[word[1:]]] if word[0] == " " else self.vocabulary.merge(word)
                add(np.array([i]), np.array(found), len(found))
            own = own[~spaced]
            if n > MERGED_BYTES or not len(own):
                continue
            table = data[starts[own][:, None] + np.arange(n)]
            at = self.lexicon.ordinals(table) if self.lexicon else np.full(len(own), -1)
            if len(hit := np.flatnonzero(at >= 0)):
                first, size = self.lexicon.offsets[at[hit]].astype(np.int64), np.diff(self.lexicon.offsets)[at[hit]]
                add(own[hit], self.lexicon.ids[_spread(first, size)], size)
            rest = np.flatnonzero(at < 0)
            self.merged += len(rest)
            for some, found in self.vocabulary.merge_many(table[rest]):
                add(own[rest[some]], found.ravel(), found.shape[1])
        if not rows:
            return pa.array([], pa.list_(pa.int32()))
        back = np.empty(len(words), np.int64)
        back[np.concatenate(rows)] = np.arange(len(words))
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        return pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate(ids).astype(np.int32)).take(pa.array(back))

    def encode_texts(self, texts: list[str | None], keep: bool = True) -> Encoded:
        """``keep=False`` leaves the ids themselves out."""
        flat, counts = chunks(self.vocabulary, texts)
        coded = flat.dictionary_encode()
        split = [[c] if c[0] == " " else self.vocabulary.split(c) for c in strings(coded.dictionary)]
        words = pa.array([w for own in split for w in own], pa.large_string()).dictionary_encode()
        # ids of distinct words, of distinct chunks, and of the chunks as they stand
        by_word = self.word_ids(words.dictionary).take(words.indices)
        ends = np.concatenate(([0], np.cumsum([len(own) for own in split], dtype=np.int64)))
        by_chunk = pa.ListArray.from_arrays(by_word.offsets.take(pa.array(ends)), by_word.values).take(coded.indices)
        starts = by_chunk.offsets.to_numpy()[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64)
        ids = by_chunk.values
        texts = [Joined(names.take(ids), starts) for names in self.names]
        return Encoded(np.diff(starts), *texts, pa.LargeListArray.from_arrays(starts, ids) if keep else None)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([text]).ids[0].as_py()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space; the file names no decoder."""
        return " ".join(self.vocabulary.tokens[i] for i in ids)


def word_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(word, n)`` over all whole texts, of words that a lexicon may have.

    A word over WORD_LENGTH characters is never worth keeping, so it isn't emitted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = Vocabulary(vocabulary), {}

        def emit() -> pa.RecordBatch:
            words: dict[str, int] = {}
            for chunk, n in seen.items():
                if chunk[0] != " ":
                    for word in v.split(chunk):
                        words[word] = words.get(word, 0) + n
            seen.clear()
            kept = [w for w in words if len(w) <= WORD_LENGTH]
            return pa.RecordBatch.from_pydict({"word": pa.array(kept, pa.string()), "n": pa.array([words[w] for w in kept], pa.int64())})

        for b in batches:
            for _, texts in text_slices(b.column("text"), SLICE):
                counts = pc.value_counts(chunks(v, texts)[0])
                for chunk, n in zip(strings(counts.field("values")), counts.field("counts").to_numpy().tolist()):
                    seen[chunk] = seen.get(chunk, 0) + n
                if len(seen) > TALLY_CHUNKS:
                    yield emit()
            pa.default_memory_pool().release_unused()
        yield emit()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def publish_lexicon(docs: DataFrame, vocabulary: str, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> str | None:
    """Compiles the frequent words of ``docs`` and ships the file to the executors; gives its name there.

    The lexicon is bounded by ``max_words`` whatever the input. None if no word is frequent.
    """
    spark = docs.sparkSession
    words = sorted(r[0] for r in most_frequent(word_counts(docs, vocabulary), min_count, max_words))
    if not words:
        return None
    v = Vocabulary(vocabulary)
    data = compile_transducer({w: v.merge(w) for w in words})
    return ship(spark, f"lexicon-{hashlib.sha256(data).hexdigest()[:16]}.mat", data)


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(vocabulary: str, name: str | None) -> Encoder:
    """The encoder of this worker process; the lexicon is mapped once."""
    if (vocabulary, name) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary, name] = Encoder(vocabulary, SparkFiles.get(name) if name else None)
    return _ENCODERS[vocabulary, name]


def encode_documents(docs: DataFrame, vocabulary: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with ``keep`` also ids and decoded text.

    ``vocabulary`` is the tokenizer file's path on every machine. A null text is empty: no tokens,
    and the digests of the empty string. Only doc_id and text are read; repeated rows give repeated
    results; an empty table gives an empty result. Special tokens within a text count as such.
    """
    name = publish_lexicon(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, name)
        for b in batches:
            for at, texts in text_slices(b.column("text"), SLICE):
                e = encoder.encode_texts(texts, keep)
                out = {"doc_id": b.column("doc_id").slice(at, len(texts)), "n_tokens": pa.array(e.n_tokens, pa.int64()), "ids_sha256": pa.array(e.ids_text.digests(), pa.string()), "decoded_sha256": pa.array(e.decoded.digests(), pa.string())}
                if keep:
                    out |= {"ids": e.ids.cast(pa.list_(pa.int32())), "decoded": e.decoded.texts().cast(pa.string())}
                yield pa.RecordBatch.from_pydict(out)
            pa.default_memory_pool().release_unused()

    more = ", ids array<int>, decoded string" if keep else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
