import random

from tests.llm.test_simhash import components
from tremorlab.llm.components import connected_components


def check(spark, pairs):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = components([p for p in pairs if None not in p and p[0] != p[1]], {x for p in pairs for x in p if x is not None})
    ends = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    assert got == {n: want[n] for n in ends}


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    check(spark, [(i, i + 1) for i in range(60)] + [(100, 1000 + i) for i in range(50)] + [(7, 7), (None, 3), (3, None), (2, 1), (1, 2)])
    check(spark, [(rng.randrange(200), rng.randrange(200)) for _ in range(130)])
    check(spark, [(5, 9), (5, 8)])


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
