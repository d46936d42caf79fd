import hashlib
import random

from tremorlab.llm import multiset_fingerprint as M


def of(text):
    return M.MultisetHash().update(text)


def test_order_free_and_incremental():
    a, b = "one two three four five\nsix\nseven eight", "seven eight\none two three four five\nsix"
    assert of(a).hexdigest() == of(b).hexdigest() != of(a + "\nsix").hexdigest()
    h = of(a + "\nmore text here").update("more text here", -1)
    assert h.hexdigest() == of(a).hexdigest()
    assert of("").hexdigest() == of("\n\n").hexdigest()
    assert of("a\nbc").hexdigest() != of("ab\nc").hexdigest()


def test_likeness_follows_what_is_shared():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    doc = "\n".join(" ".join(word() for _ in range(40)) for _ in range(12))
    other = "\n".join(" ".join(word() for _ in range(40)) for _ in range(12))
    new, h = M.edited_hash(of(doc), doc, other)
    assert h.hexdigest() == of(new).hexdigest()
    assert 0.5 < of(doc).likeness(h) < 0.85 and of(doc).likeness(of(other)) < 0.2
    assert of(doc).likeness(of(doc)) == 1.0 == of("").likeness(of("")) and of("").likeness(of("a")) == 0.0


def test_likeness_survives_a_word_inserted_or_deleted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for paragraphs, words, least in ((1, 240, 0.95), (8, 30, 0.8)):
        doc = [[word() for _ in range(words)] for _ in range(paragraphs)]
        text = "\n".join(map(" ".join, doc))
        longer = "\n".join(" ".join([*w[:1], word(), *w[1:]]) for w in doc)
        shorter = "\n".join(" ".join([*w[:2], *w[3:]]) for w in doc)
        assert of(text).likeness(of(longer)) > least and of(text).likeness(of(shorter)) > least


def test_long_repetitive_texts_do_not_wrap():
    for times in (20_000, 40_000, 120_000):
        text = "a b c d " * times
        new, h = M.edited_hash(of(text), text, "other words " * times)
        assert 0.6 < of(text).likeness(h) < 0.98, times


def test_query_equals_a_walk_in_order(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(10**6) * 2 + 2**60, "".join(rng.choice("ab \né") for _ in range(rng.choice([0, 1, 2, 5, 300])))) for _ in range(300)]
    rows += [(-5, None), (-6, "x"), (7, "tie b"), (7, "tie a"), (None, "null"), (1, "long " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 b", "2 halo", "3 bucket").repartition(5)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        new = M.edited(t, nxt)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), of(t).hexdigest(), of(new).hexdigest(), of(t).likeness(of(new)), of(t).likeness(of(nxt))))
    got = [tuple(r) for r in M.fingerprint_with_next(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    lone = spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")
    assert M.fingerprint_with_next(lone).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert M.fingerprint_with_next(lone.where("false")).count() == 0
