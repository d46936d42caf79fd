"""Packing of token ids into windows by the online Sum-of-Squares rule.

A document longer than a window first fills whole windows; its remainder is placed into the window,
among those partly filled or a new one, that minimises the sum over fill levels of the squared
number of windows at that level. A level array holds these counts, so a placement is one vector
operation over it. Of the windows still open at the end of a partition, the fullest are filled up with ids of the
emptiest, and the last ids make sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlab.llm.common import chunks, map_lists, typed

WINDOW = 4096
END_ID = 2
#: Partly filled windows a task keeps before it joins them; bounds its memory to OPEN_WINDOWS * WINDOW ids.
OPEN_WINDOWS = 2048
#: Words remembered, documents taken at once and characters of text whose unknown words are encoded together; these bound a worker's memory.
CACHE_ROWS = 400_000
ROWS = 2000
CHUNK_CHARS = 1_000_000
CACHE_CHARS = 64
#: Unknown words that go through the tokenizer as one text.
WORDS_AT_ONCE = 4000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space on which str.split and the tokenizer may differ; texts with it are encoded whole.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class WordTokenizer:
    """Ids by a tokenizer that drops white space, as little-endian unsigned 32-bit bytes, with a bounded memory of words."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True
        self.ids: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        #: Words that came again in a later run of texts; most words never do.
        self.again: set[str] = set()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of texts without white space: many are encoded as one text, then parted by the offsets of the ids."""
        out = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            begin = np.array([a for a, _ in e.offsets], dtype=np.int64)
            ends = np.cumsum([len(w) + 1 for w in part])
            cut = np.searchsorted(begin, ends, side="left").tolist()
            raw = ids.tobytes()
            out += [raw[4 * i : 4 * j] for i, j in zip([0, *cut], cut)]
        return out

    def _learn(self, words: set[str]) -> None:
        """Words without their closing ASCII punctuation, in lower case, are fewer; the tokenizer splits there anyway."""
        parts = []
        for w in words:
            core = w.rstrip(PUNCTUATION)
            if core and core[-1].isalnum():
                parts.append((w, core.lower() if core.isascii() else core, w[len(core) :]))
            else:
                parts.append((w, w, ""))
        new = list({p for _, core, tail in parts for p in (core, tail)} - self.cores.keys())
        self.cores.update(zip(new, self._encode_words(new)))
        for w, core, tail in parts:
            self.ids[w] = self.cores[core] + self.cores[tail]

    def _forget(self) -> None:
        """Only words that came again stay; none do where these would fill half of the memory."""
        stay = self.again if 2 * len(self.again) <= CACHE_ROWS else set()
        self.ids, self.cores, self.again = {w: self.ids[w] for w in stay if w in self.ids}, {}, set()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for part in chunks(texts, CHUNK_CHARS):
            split = [None if ODD_SPACE.search(t) else t.split() for t in part]
            words = set().union(*(w for w in split if w))
            new = words - self.ids.keys()
            self.again |= words - new
            if new:
                self._learn(new)
            for text, words in zip(part, split):
                yield self._encode([text])[0] if words is None else b"".join(map(self.ids.__getitem__, words))
            for w in new:
                if len(w) > CACHE_CHARS:
                    del self.ids[w]
                    self.cores.pop(w, None)
            if len(self.ids) > CACHE_ROWS:
                self._forget()


class SumOfSquaresPacker:
    """Online packer; add() and finish() give the pieces of sequences as they are settled."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit = window, open_windows
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = self.next_id = 0

    def level_for(self, size: int) -> int:
        """The fill level, 0 for a new window, where ``size`` ids keep the sum of squares least; the fullest of equals."""
        top = self.window - size
        n = self.count
        after = 2 * n[size : size + top + 1] + 1
        after[top] = 0
        cost = after - 2 * n[: top + 1] + 1
        cost[n[: top + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = after[0]
        return top - int(np.argmin(cost[::-1]))

    def _settle(self, pieces: list[tuple]) -> list[tuple]:
        seq, at, out = self.next_id, 0, []
        self.next_id += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            out.append((doc, start, n, zlib.crc32(ids), total, seq, at))
            at += n
        return out

    def add(self, doc: object, ids: bytes) -> list[tuple]:
        """Place one document, given as 4-byte ids."""
        total, start, out, w = len(ids) // 4, 0, [], self.window
        while total - start >= w:
            out += self._settle([(doc, start, ids[4 * start : 4 * (start + w)], total)])
            start += w
        size = total - start
        if not size:
            return out
        level = self.level_for(size)
        if level:
            self.count[level] -= 1
            pieces = self.open[level].pop()
            self.n_open -= 1
        else:
            pieces = []
        pieces.append((doc, start, ids[4 * start :], total))
        if level + size == w:
            out += self._settle(pieces)
        else:
            self.count[level + size] += 1
            self.open.setdefault(level + size, []).append(pieces)
            self.n_open += 1
            if self.n_open > self.limit:
                out += self.finish()
        return out

    def finish(self) -> list[tuple]:
        """Settle the open windows: the fullest stay as placed and are filled up with ids of the emptiest, whose documents alone are cut.

        What no longer fills a window becomes sequences whose lengths are powers of two, which need no padding.
        """
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.count[:], self.open, self.n_open = 0, {}, 0
        out, rest, first, last = [], [], 0, len(windows) - 1
        while first <= last or rest:
            pieces = []
            if first <= last:
                pieces = windows[first]
                first += 1
            room = self.window - sum(len(p[2]) // 4 for p in pieces)
            while room and (rest or first <= last):
                if not rest:
                    rest = windows[last][::-1]
                    last -= 1
                head, tail = self._cut(rest.pop(), room)
                pieces.append(head)
                room -= len(head[2]) // 4
                rest += tail
            while pieces:
                n = sum(len(p[2]) // 4 for p in pieces)
                size = self.window if n >= self.window else 1 << (n.bit_length() - 1)
                sequence, pieces = [], pieces[::-1]
                while size:
                    head, tail = self._cut(pieces.pop(), size)
                    sequence.append(head)
                    size -= len(head[2]) // 4
                    pieces += tail
                pieces = pieces[::-1]
                out += self._settle(sequence)
        return out

    @staticmethod
    def _cut(piece: tuple, n: int) -> tuple[tuple, list[tuple]]:
        """The first ``n`` ids of a piece, or all, and what is left of it."""
        doc, start, ids, total = piece
        if len(ids) <= 4 * n:
            return piece, []
        return (doc, start, ids[: 4 * n], total), [(doc, start + n, ids[4 * n :], total)]


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(spec: str) -> WordTokenizer:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordTokenizer(spec)
    return _loaded[key]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every partition packs its own rows in their order, without a shuffle; sequence ids carry the
    partition's number, so a task that runs again gives the same rows. Null and empty texts are the
    end id alone. Repeated rows are packed each; null ids stay null; other columns are ignored; an
    empty table gives an empty result.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        tok, packer = _tokenizer(spec.value), SumOfSquaresPacker(window)
        end, base = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId() << 40

        def columns(rows: list[tuple]) -> dict:
            out = dict(zip(names, zip(*rows)))
            out["sequence_id"] = [base + s for s in out["sequence_id"]]
            return out

        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"], tok.encode([t or "" for t in b["text"]])):
                rows += packer.add(doc, ids + end)
            if rows:
                yield columns(rows)
        if rows := packer.finish():
            yield columns(rows)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_lists(rows, run, typed(docs, id_col, **{n: T.LongType() for n in names[1:]}), ROWS)
