import random

import numpy as np

from tremorlab.llm import quality_ranking as Q


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(10, 60))]
        good = rng.random() < 0.8
        kind = rng.randrange(3)
        if good:
            text = " ".join(words).capitalize() + "."
        elif kind == 0:
            text = " ".join(w + "***" for w in words)
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in words)
        else:
            text = " | ".join(words)
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = x @ [2.0, -1.0, 0.0] > 0
    w = Q.bradley_terry(x[y], x[~y])
    assert w[0] > 0.5 and w[1] < -0.25 and abs(w[2]) < 0.3 * w[0]


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus()
    docs += [(900, None), (901, ""), (None, "fine text here."), (902, "x" * 200_000), (902, "x" * 200_000)]
    labels += [(900, None), (None, 1), (901, None), (3, labels[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 label", "2 x").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = Q.train(d, lab)
    got = Q.score_quality(d, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = dict(x for x in labels if x[1] is not None and x[0] is not None)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_cut_withstands_wrong_labels():
    raw = np.concatenate([np.linspace(-5, -4, 50), np.linspace(1, 3, 400)])
    y = np.r_[np.zeros(50, int), np.ones(400, int)]
    y[60::40] = 0
    assert -4 < Q.best_quantile(raw, y, np.ones(450)) < 1


def test_one_class_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.score_quality(d, Q.train(d, lab)).first().predicted == 1
    assert Q.score_quality(d.where("false"), Q.train(d.where("false"), lab.where("false"))).count() == 0
