import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tremorlab.llm import byte_bpe as B
from tremorlab.llm import packing as K

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(1)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x1F300, 0x1F6FF), 10, 32, 9, 0x1C, 0x85]))
    return ["".join(pick() for _ in range(120)) for _ in range(60)] + [None, "", "a" * 3000, "ab" * 700, " " * 700, "<|endoftext|> it's The End!! x.", "straße ÉTÉ don't 12 345"]


@pytest.fixture(scope="module")
def bpe():
    with open(RANKS, "rb") as f:
        return B.ByteBpe(f.read(), P.PATTERN)


def test_ids_equal_the_library(bpe):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for t in odd_texts():
        ids = bpe.encode(t or "")
        assert ids == ref.encode_ordinary(t or "")
        assert bpe.decode(ids) == (t or "").encode()


def test_long_words_take_the_same_merges(bpe):
    rng = random.Random(2)
    for _ in range(40):
        w = bytes(rng.choice(b"aabthe \xc3\xa9") for _ in range(rng.randint(1, 300)))
        assert bpe._encode_long(w).tolist() == bpe._encode_matrix([w])[0].tolist()


def test_bpe_query(spark, bpe):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n_tokens").repartition(3)
    got = sorted(map(tuple, B.bpe_digests(df, RANKS, P.PATTERN).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = bpe.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def brute_level(count, size, window):
    """The level by the definition: try each, take the least sum of squares, the fullest of equals."""
    best = None
    for h in range(window - size + 1):
        if h and not count[h]:
            continue
        c = list(count)
        if h:
            c[h] -= 1
        if h + size < window:
            c[h + size] += 1
        s = sum(int(x) ** 2 for x in c[1:window])
        if best is None or s <= best[0]:
            best = (s, h)
    return best[1]


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(5)
    p = K.SumOfSquaresPacker(window=24)
    for i in range(400):
        size = rng.randint(1, 23)
        assert p.level_for(size) == brute_level(p.count, size, 24)
        p.add(i, b"\0\0\0\0" * size)


def test_pack_covers_every_id_without_padding(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(500, "word " * 20000), (501, "x " * 4095), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 length").repartition(3)
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    pieces, seqs = {}, {}
    for r in K.pack(df, WORDS).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == {i for i, _ in rows}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], dtype="<u4").tobytes())
        assert at == len(ids)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == K.WINDOW or at & (at - 1) == 0


def test_end_of_a_task_keeps_placements():
    """Of the windows open at the end, only the emptiest are cut, and no id is lost or padded."""
    rng = random.Random(11)
    packer, out, lengths = K.SumOfSquaresPacker(window=4096), [], []
    for i in range(1500):
        lengths.append(min(4000, int(rng.expovariate(1 / 500)) + 1))
        out += packer.add(i, b"\1\0\0\0" * lengths[-1])
    filling = sum(len(w) for ws in packer.open.values() for w in ws)
    out += packer.finish()
    pieces, seqs = {}, {}
    for doc, start, n, _, _, seq, at in out:
        pieces.setdefault(doc, []).append((start, n))
        seqs.setdefault(seq, []).append((at, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces[i]):
            assert start == at
            at += k
        assert at == n
    sizes = [sum(n for _, n in s) for s in seqs.values()]
    assert all(x == 4096 or x & (x - 1) == 0 for x in sizes) and sum(x < 4096 for x in sizes) <= 12
    assert sum(len(p) > 1 for p in pieces.values()) < 0.5 * filling


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert K.pack(df, WORDS).count() == 0 and B.bpe_digests(df, RANKS, P.PATTERN).count() == 0


def test_a_packing_worker_stays_small():
    """Memory of a worker that takes a batch of 10000 texts with a million different words."""
    run = """
import random, resource, sys
import pyarrow as pa, public_tokenizers as P
from pyspark.sql import types as T
from tremorlab.llm import common, packing as K
class Frame:
    def mapInArrow(self, f, schema): return f
rng = random.Random(1)
batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10000)), "text": [" ".join("%07x" % rng.randrange(1 << 28) for _ in range(100)) for _ in range(10000)]})
tok, packer = K.WordTokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read()), K.SumOfSquaresPacker()
now = lambda: int(open("/proc/self/statm").read().split()[1]) * resource.getpagesize() >> 20
start, seen = now(), [0]
def work(batches):
    for b in batches:
        for doc, ids in zip(b["doc_id"], tok.encode(b["text"])):
            packer.add(doc, ids)
        seen.append(now())
        yield {"doc_id": []}
rows = [K.ROWS] if hasattr(K, "ROWS") else []
list(common.map_lists(Frame(), work, T.StructType([T.StructField("doc_id", T.LongType())]), *rows)([batch]))
print(max(seen) - start)
"""
    out = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], check=True)
    assert int(out.stdout) < 190, out.stdout


def test_words_that_come_again_outlast_a_full_memory(monkeypatch):
    """Once the memory is full only words of one run of texts go; ids stay those of whole texts."""
    monkeypatch.setattr(K, "CACHE_ROWS", 60)
    monkeypatch.setattr(K, "CHUNK_CHARS", 1)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tok = K.WordTokenizer(f.read())
    learned = []
    learn = tok._learn
    tok._learn = lambda words: (learned.extend(words), learn(words))
    texts = [f"often and again here {' '.join(f'once{i}x{j}' for j in range(9))}" for i in range(30)]
    assert list(tok.encode(texts)) == tok._encode(texts)
    assert learned.count("often") == 1 and len(tok.ids) <= 60 + 13
