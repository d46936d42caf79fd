"""Byte-level BPE by rank files, encoded in length-bucketed padded matrices.

The distinct pre-tokens of a batch are dealt into buckets by length; each bucket is one padded
matrix of ids. In every round each row merges its leftmost pair of minimum rank; pair ranks come
from an open-addressing hash table over (left id, right id), and after a merge the row closes up.
Rows without a mergeable pair leave the matrix. Pre-tokens above ``MATRIX_BYTES`` would need as many
rounds as they have bytes; a heap over a linked list gives them the same merges in the same order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlab.llm.common import chunks, map_lists, typed

MATRIX_BYTES = 512
MATRIX_CELLS = 1 << 20
#: Distinct pre-tokens that a Python worker remembers, and the longest it keeps.
CACHE_ROWS = 500_000
CACHE_CHARS = 64
#: Characters of text whose unknown pre-tokens are encoded together.
CHUNK_CHARS = 4_000_000

NONE = np.int32(2**31 - 1)


class ByteBpe:
    """Encoder and decoder for one rank file (lines of base64 token and rank) and one split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.bytes_to_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._build_pairs()

    def _build_pairs(self) -> None:
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        bits = max(4, (2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = np.fromiter(pairs, dtype=np.uint64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        self.keys = np.full(1 << bits, 2**64 - 1, dtype=np.uint64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = np.flatnonzero(self.keys[s] == np.uint64(2**64 - 1))
            _, first = np.unique(s[free], return_index=True)
            put = todo[free[first]]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = todo[~np.isin(todo, put)]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where there is none or an end is padding (-1)."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = left.ravel()[at].astype(np.uint64) << np.uint64(32) | right.ravel()[at].astype(np.uint64)
        slot = self._slot(keys)
        flat = out.reshape(-1)
        while len(at):
            seen = self.keys[slot]
            hit = seen == keys
            flat[at[hit]] = self.values[slot[hit]]
            more = ~hit & (seen != np.uint64(2**64 - 1))
            at, keys, slot = at[more], keys[more], (slot[more] + 1) & self.mask
        return out

    def _encode_matrix(self, words: list[bytes]) -> list[np.ndarray]:
        width = max(map(len, words))
        m = np.full((len(words), width), -1, dtype=np.int32)
        for r, w in enumerate(words):
            m[r, : len(w)] = self.bytes_to_id[np.frombuffer(w, dtype=np.uint8)]
        row, out = np.arange(len(words)), [None] * len(words)
        ranks = self.pair_ranks(m[:, :-1], m[:, 1:])
        while len(row):
            done = (ranks.min(axis=1) if ranks.shape[1] else np.full(len(row), NONE)) == NONE
            for r, ids in zip(row[done], m[done]):
                out[r] = ids[ids >= 0]
            m, ranks, row = m[~done], ranks[~done], row[~done]
            if not len(row):
                break
            p, r = ranks.argmin(axis=1), np.arange(len(row))
            m[r, p] = ranks[r, p]
            cols = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, cols + (cols >= p[:, None] + 1), axis=1)
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= p[:, None]), axis=1)
            for q in (p - 1, p):
                ok = (q >= 0) & (q < ranks.shape[1])
                ranks[r[ok], q[ok]] = self.pair_ranks(m[r[ok], q[ok]], m[r[ok], q[ok] + 1])
        return out

    def _encode_long(self, word: bytes) -> np.ndarray:
        ids = self.bytes_to_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, after, before, get = len(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), self.pairs.get
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode_words(self, words: Iterable[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        words = list(words)
        out: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if not w:
                out[i] = np.zeros(0, dtype=np.int32)
            elif len(w) > MATRIX_BYTES:
                out[i] = self._encode_long(w)
            else:
                buckets.setdefault((len(w) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            step = max(1, MATRIX_CELLS >> bits)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._encode_matrix([words[i] for i in part])):
                    out[i] = ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [i for ids in self.encode_words(w.encode() for w in self.split(text)) for i in ids.tolist()]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))


class CachedCodec:
    """Per-text digests through a bounded memory of pre-tokens."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.ids, self.count, self.back = bpe, {}, {}, {}

    def _learn(self, words: set[str]) -> None:
        words = list(words)
        for w, ids in zip(words, self.bpe.encode_words(w.encode() for w in words)):
            ids = ids.tolist()
            self.ids[w], self.count[w], self.back[w] = ",".join(map(str, ids)), len(ids), self.bpe.decode(ids)

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the comma-joined ids, SHA-256 of the decoded bytes) of each text."""
        for part in chunks(texts, CHUNK_CHARS):
            split = [self.bpe.split(t) for t in part]
            new = set().union(*split) - self.ids.keys()
            if new:
                self._learn(new)
            for words in split:
                ids = ",".join(map(self.ids.__getitem__, words))
                back = b"".join(map(self.back.__getitem__, words))
                yield sum(map(self.count.__getitem__, words)), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()
            if len(self.ids) > CACHE_ROWS:
                self.ids, self.count, self.back = {}, {}, {}
            else:
                for w in new:
                    if len(w) > CACHE_CHARS:
                        del self.ids[w], self.count[w], self.back[w]


_loaded: dict[str, CachedCodec] = {}


def _codec(rank_file: bytes, pattern: str) -> CachedCodec:
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = CachedCodec(ByteBpe(rank_file, pattern))
    return _loaded[key]


def bpe_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``rank_path`` is read by the driver and sent along, so executors need no copy of it. Null counts
    as empty: no tokens, and the digests of nothing. Special-token strings are ordinary text. Rows
    are independent, so repeats, ties and other columns change nothing.
    """
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = _codec(ranks.value, pattern)
        for b in batches:
            n, ids, back = zip(*codec.digest([t or "" for t in b["text"]])) if b["text"] else ([], [], [])
            yield {"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_lists(rows, run, typed(docs, id_col, n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType()))
