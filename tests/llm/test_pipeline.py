import corpus_pipeline as P
from tests.llm.test_line_dedup import brute
from tests.llm.test_simhash import brute_fingerprint, components
from tremorlab.llm.language_id import has_letter

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    extra = spark.createDataFrame([(1000, None, "en", "src1", 0), (1001, "12 !", "en", None, 4), (None, "and the thing of", "en", "src2", 16)], docs.schema)
    docs = docs.unionByName(extra)
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = after.collect()
        if name != "packing":
            assert after.columns == docs.columns
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        if name == "language_id":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before if has_letter(r.text)}
        if name == "line_dedup":
            short = [(r.doc_id, r.text) for r in before]
            assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(brute(short), key=repr)
        if name == "simhash_near_dedup":
            fp = {r.doc_id: brute_fingerprint(r.text) for r in before}
            nodes = sorted(set(fp.values()))
            comp = components([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3], nodes)
            least = {}
            for i, f in fp.items():
                if i is not None:
                    least[comp[f]] = min(least.get(comp[f], i), i)
            assert {r.doc_id for r in rows} - {None} == set(least.values())
        if name == "secret_scan":
            assert len(rows) == len(before)
        if name == "packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
        docs = after


def test_stages_take_odd_tables(spark):
    """Nulls, repeats, ties, a long text, clashing names and an empty table: each stage runs and keeps its columns and clean rows."""
    names = ["__key", "__doc", "c0", "line", "live", "stays", "key", "gone", "text_key", "fp", "rid", "__rn"]
    clean = [(i, f"The committee number {i} met and found that plan {i * 7} was sound, with words {i}a {i}b {i}c {i}d.", "en", f"s{i % 3}", 1) for i in range(30)]
    odd = [(100, None, None, None, None), (101, "", "en", "s1", 0), (None, "Another text about the garden and the rain that fell on it.", "en", None, 3), (102, "long words in a row " * 20_000, "en", "s1", 9)]
    df = spark.createDataFrame(clean + clean[:3] + odd, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'{x}' `{x}`" for x in names]).repartition(3)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        rows = out.collect()
        assert {r.doc_id for r in rows} >= set(range(30)) and all([r[x] for x in names] == names for r in rows), name
        assert len(rows) >= (34 if name != "simhash_near_dedup" else 30), name
        assert stage(spark, df.where("false"), SF).count() == 0, name
    assert {r.doc_id for r in P.STAGES[-1][1](spark, df, SF).collect()} == {None, 100, 101, 102, *range(30)}
