import random

import numpy as np
import xxhash

from tremorlab.llm import simhash_vptree as S


def brute_fingerprint(t):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_definition():
    for t in [None, "", " \t ", "One", "one TWO", "É é A\x0bb c d\xa0e f", "a b c " * 50]:
        assert S.fingerprint(t) == brute_fingerprint(t)


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(220):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(120)]
        rows.append((i * 3, " ".join(words)))
        for k in range(rng.choice([0, 0, 1, 3])):
            w = list(words)
            w[rng.randrange(120)] = "zz"
            rows.append((i * 3 + 1 + k % 2, " ".join(w)))
    rows += [(5000, None), (4999, ""), (None, "x y z"), (7, "x y z"), (7, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body")
    got = {}
    for r in S.simhash_components(df, text_col="body").collect():
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    nodes = sorted({brute_fingerprint(t) for _, t in rows})
    comp = components([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3], nodes)
    least = {}
    for i, t in rows:
        c = comp[brute_fingerprint(t)]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = {}
    for i, t in rows:
        f = brute_fingerprint(t)
        want.setdefault(i, []).append((f"{f:016x}", least[comp[f]]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_search_loses_no_link_when_shards_are_divided(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.concatenate([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for a, b, c in rng.integers(0, 64, (4, 3))])
    f = np.unique(np.concatenate([base, near]))
    monkeypatch.setattr(S, "DIRECT", 16)
    edges = []
    for mask in S.HALVES:
        nodes = S.build_tree(f[::3], mask, 20)
        rows, shards = S.route(f, nodes, mask)
        for s in set(shards):
            a, b = S.search(f[rows[shards == s]], mask)
            edges += list(zip(a.tolist(), b.tolist()))
    all_ = f.tolist()
    want = components([(a, b) for a in all_ for b in all_ if a < b and (a ^ b).bit_count() <= 3], all_)
    assert components(edges, all_) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp int, component string")
    assert S.simhash_components(df).count() == 0


def test_one_document_of_each_component_stays(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda: " ".join(word() for _ in range(80))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(1, a), (2, a), (2, a), (None, a), (3, b), (3, c), (None, d), (None, e), (None, d), (5, f), (5, f), (9, None), (8, ""), (7, " ")]
    rows += [(100 + i, t) for i, t in enumerate(w for _ in range(60) for w in [text()])]
    names = ["doc_id", "text", "c0", "c1", "text_key", "fp", "n", "unsure", "stays", "__keep", "__rn", "component"]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'{x}' `{x}`" for x in names[2:]]).repartition(4)
    out = S.drop_near_duplicates(df)
    assert out.columns == names
    got = out.collect()
    want = [(1, a), (3, b), (3, c), (None, d), (None, e), (5, f), (7, " "), *rows[14:]]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert all(list(r)[2:] == names[2:] for r in got)
    assert S.drop_near_duplicates(df.where("false")).count() == 0


def test_rows_sent_do_not_grow_faster_than_the_input():
    """Shard rows of each input row, with trees on a sample of bounded size, at ten times the input."""
    rng = np.random.default_rng(1)
    sent = []
    for n in (100_000, 1_000_000):
        f = rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + rng.integers(0, 2, n, dtype=np.uint64)
        sample = f[: S.SAMPLE]
        nodes = S.build_tree(sample, S.HALVES[0], max(8, int(S.SHARD_ROWS * len(sample) / n)))
        rows, shards = S.route(f, nodes, S.HALVES[0])
        assert np.bincount(shards).max() < S.BLOCK_ROWS
        sent.append(len(rows) / n)
    assert sent[1] < 2 * sent[0] < 12
