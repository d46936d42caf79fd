import random
import zlib

import numpy as np

from tremorlab.llm import language_id as L

WORDS = {"aa": "der die und nicht schön straße haben".split(), "bb": "the and with thing would have".split(), "cc": "les une avec être déjà pour".split()}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(4, 40))), k) for i in range(n) for k in [rng.choice(sorted(WORDS))]]


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(400) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (1003, "the and with", None), (None, "der die und", "aa"), (1003, "the and with", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 score", "2 idx").repartition(3)
    model = L.train(df)
    got = L.predict_languages(df, model).collect()
    assert len(got) == len(rows)
    truth = {i: k for i, _, k in rows if i is not None and i < 1000}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[1003].lang_pred == "bb" and by[None].held_out is None and by[None].lang_pred == "aa"
    for r in got:
        assert 0 <= r.score <= 1 and (r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2))
    kept = {r.doc_id for r in L.keep_identified(df, model).collect()}
    assert set(truth) <= kept and not kept & {1000, 1001, 1002}


def test_training_ignores_held_out_labels(spark):
    rows = corpus(200)
    flipped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows]
    a, b = (L.train(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, flipped))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_whole_texts_are_counted_across_chunks(monkeypatch):
    text = "".join(random.Random(0).choice("abé! Z") for _ in range(3000))
    want = L.ngram_counts(text)
    monkeypatch.setattr(L, "CHUNK", 1 << 10)
    got = L.ngram_counts(text)
    assert abs(int(got[1].sum()) - int(want[1].sum())) <= 9


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.predict_languages(df, L.train(df)).first().lang_pred == "und"
    assert L.predict_languages(df.where("false"), L.train(df.where("false"))).count() == 0


def test_pipeline_stage_rejects_what_is_in_no_language(spark):
    import base64

    import corpus_pipeline

    rng = random.Random(3)
    clean = corpus(400) + [(500 + i, " ".join(rng.choice(WORDS["aa"] + WORDS["bb"]) for _ in range(80)), "aa") for i in range(20)] + [(600, "der", "aa"), (601, "the and", None)]
    junk = [base64.b64encode(rng.randbytes(900)).decode(), "\u044d\u0442\u043e \u0442\u0435\u043a\u0441\u0442 " * 40, " ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(99)), rng.randbytes(600).hex(), "12 !!", None]
    df = spark.createDataFrame(clean + [(900 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, df, "").collect()} == {i for i, _, _ in clean}
    unlabelled = df.withColumn("lang", df.lang.substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') lang")
    assert corpus_pipeline.language_stage(spark, unlabelled, "").count() == len(clean) + len(junk)


def test_chunks_change_no_count(monkeypatch):
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice("ab é  ..9ß") for _ in range(rng.randint(0, 200)))
        whole = L.ngram_counts(text)
        for size in (1, 2, 3, 7, 50):
            monkeypatch.setattr(L, "CHUNK", size)
            got = L.ngram_counts(text)
            assert np.array_equal(whole[0], got[0]) and np.array_equal(whole[1], got[1])
        monkeypatch.undo()
