import random
import zlib

import numpy as np

from tremorlab.llm import toxicity as X


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    bad = ["idiot", "stupid", "pathetic", "worthless", "scum"]
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus()
    docs += [(900, None), (901, ""), (None, "you stupid idiot you pathetic scum"), (902, "y " * 100_000), (902, "y " * 100_000)]
    labels += [(900, None), (None, 1), (901, None), (3, labels[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 label", "2 x").repartition(3)
    model = X.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = X.score_toxicity(d, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = dict(x for x in labels if x[1] is not None and x[0] is not None)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[None].held_out is None and by[900].predicted == by[901].predicted == 0


def test_lexicon_is_learned_from_the_training_fold_alone(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        words = [word() for _ in range(rng.randint(20, 60))] + (["qqzz" + word() for _ in range(rng.randint(3, 6))] if toxic else [])
        words += ["heldoutonly"] if toxic and zlib.crc32(str(i).encode()) % 3 == 1 else []
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = X.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "qqzz*" in model.learned and not any(x.startswith("heldout") for x in model.learned)
    got = [r for r in X.score_toxicity(d, model).collect() if r.held_out]
    hits = sum(r.predicted for r in got if dict(labels)[r.doc_id])
    assert hits >= 0.95 * sum(dict(labels)[r.doc_id] for r in got) and sum(r.predicted for r in got) <= 1.05 * hits


def test_features_see_obfuscation_and_second_person():
    f = dict(zip(X.FEATURES, X.features("YOU are an id1ot, you idiot! s t u p i d")))
    assert f["obfuscated_words"] > 0 and f["near_second_person"] > 0 and f["spaced_rate"] > 0 and f["capital_words"] > 0
    assert X.features("") == X.features(None) == [0.0] * len(X.FEATURES)


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 12, 80) / 1.0, rng.integers(0, 2, 80) / 1.0, rng.random(80) + 0.1
    starts, means = X.isotonic(x, y, w)
    assert (np.diff(means) > 0).all()
    for k in sorted(set(x)):  # min-max formula of isotonic regression
        want = max(min((w * y)[(x >= a) & (x <= b)].sum() / w[(x >= a) & (x <= b)].sum() for b in set(x) if b >= k) for a in set(x) if a <= k)
        assert abs(means[np.searchsorted(starts, k, side="right") - 1] - want) < 1e-12


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((1500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    m = X.boost(x, y, np.ones(len(y)))
    assert ((m.margin(x) > 0) == y).mean() > 0.95


def test_one_class_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert X.score_toxicity(d, X.train(d, lab)).first().predicted == 0
    assert X.score_toxicity(d.where("false"), X.train(d.where("false"), lab.where("false"))).count() == 0
