import hashlib

from tremorlab.llm.exact_dedup import exact_dedup, frequent_digests


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_hot_and_cold_groups_nulls_and_repeats(spark):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, f"t{i % 150}") for i in range(400)]
    rows += [(5, None), (6, ""), (None, "only null id"), (7, "Hot"), (7, "Hot"), (8, "x" * 300000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 digest", "2 kept").repartition(7)
    for tracked in (8, 64):
        got = [tuple(r) for r in exact_dedup(df, tracked=tracked).collect()]
        assert sorted(got, key=repr) == expected(rows)


def test_winners_are_verified_and_bounded(spark):
    df = spark.range(3000).selectExpr("id doc_id", "case when id % 3 = 0 then X'00' else cast(cast(id % 1500 as string) as binary) end digest")
    won = frequent_digests(df.repartition(5), 16).collect()
    assert [(bytes(r.digest), r.keep_id, r.group_size) for r in won] == [(b"\0", 2997, 1000)]


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_empty_partitions_are_merged(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
        assert {r.keep_id for r in exact_dedup(df).collect()} == {2}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
