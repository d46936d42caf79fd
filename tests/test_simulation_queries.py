import pytest

from tests.helpers import SF
from tremorlab import plans
from tremorlab.plans.base import scored


@pytest.mark.parametrize("name", ["mc_gbm", "mc_garch_jumps", "mc_regime_tails", "seed_stability"])
def test_every_scored_row_has_a_result(spark, name):
    keys = ["ticker", "idx", "horizon"]
    want = scored(spark, SF).select(*keys)
    got = plans.queries()[name](spark, SF).select(*keys).distinct()
    assert got.count() == want.count() and want.exceptAll(got).isEmpty()


def test_garch_is_refitted_every_21_rows(spark):
    at = {}
    for r in plans.queries()["garch_fit"](spark, SF).select("ticker", "idx").collect():
        at.setdefault(r.ticker, []).append(r.idx)
    for v in at.values():
        v.sort()
        assert len(v) > 20 and {b - a for a, b in zip(v, v[1:])} == {21}
    f = plans.queries()["garch_cdf_baseline"](spark, SF).select("ticker", "idx")
    firsts = {r.ticker: r.first for r in f.groupBy("ticker").agg({"idx": "min"}).toDF("ticker", "first").collect()}
    assert all(firsts[t] <= min(v) + 1 for t, v in at.items())
