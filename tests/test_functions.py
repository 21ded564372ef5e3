import math

import pytest
from pyspark.sql import functions as F

from fillwatch.config import CostModel, OnlineConfig, WindowSpec
from fillwatch.functions import labels, mathx, special
from fillwatch.operators.backtest import expected_max_sharpe


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_normal_distribution(spark):
    for x in (-8.0, -3.3, -0.2, 0.0, 1.7, 6.0, 12.0):
        r = one(spark, cdf=mathx.norm_cdf(F.lit(x)), sf=mathx.norm_sf(F.lit(x)))
        assert r.cdf == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-10)
        assert r.sf == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), rel=1e-8)
    for p in (1e-12, 0.003, 0.4, 0.5, 0.9, 1 - 1e-9):
        q = one(spark, q=mathx.norm_ppf(F.lit(p))).q
        assert 0.5 * math.erfc(-q / math.sqrt(2)) == pytest.approx(p, rel=1e-9)
    assert one(spark, q=mathx.norm_ppf(F.lit(0.0))).q is None


def test_tail_functions(spark):
    r = one(spark, even=mathx.chi2_sf_even(F.lit(7.5), F.lit(4)), odd=special.chi2_sf(F.lit(3.841458820694124), F.lit(1.0)),
            t=special.t_quantile(F.lit(0.975), F.lit(10.0)), b=special.binom_quantile(F.lit(0.975), F.lit(20), F.lit(0.3)))
    assert r.even == pytest.approx(math.exp(-3.75) * 4.75)
    assert r.odd == pytest.approx(0.05, abs=1e-9) and r.t == pytest.approx(2.2281388519649385, abs=1e-9) and r.b == 10.0


def test_fees_and_costs(spark):
    r = one(spark, a=mathx.billed_fee(F.lit(0.5), F.lit(100), 0.07), b=mathx.entry_cost(F.lit(0.6), F.lit("no"), 0.02, 0.07),
            c=mathx.entry_cost(F.lit(0.6), F.lit("maybe"), 0.02, 0.07))
    assert r.a == 1.75 and r.b == pytest.approx(0.4 + 0.01 + 0.07 * 0.24) and r.c is None
    with pytest.raises(ValueError):
        CostModel(spread=-0.1)


def test_configs_reject_bad_values():
    for kw in (dict(forgetting=0.0), dict(schedule="x"), dict(rho_alpha=0.5), dict(rho_t0=1.0), dict(beta_window=1)):
        with pytest.raises(ValueError):
            OnlineConfig(**kw)
    with pytest.raises(ValueError):
        WindowSpec(before=1.0, embargo=2.0)
    assert WindowSpec().locked and not WindowSpec(embargo=0.0).locked


def test_expected_max_sharpe_grows_with_trials(spark):
    df = spark.createDataFrame([(n, 0.04) for n in (1, 2, 5, 9, 50)], "n INT, v DOUBLE")
    vals = [r.s for r in df.select("n", expected_max_sharpe("v", "n").alias("s")).orderBy("n").collect()]
    assert vals[0] == 0.0 and vals == sorted(vals) and vals[-1] > vals[1]


def test_uniforms_depend_on_keys_only(spark):
    df = spark.range(2000).select("id", labels.uniform01(1, 2, "id").alias("u"))
    a = {r.id: r.u for r in df.collect()}
    b = {r.id: r.u for r in df.repartition(13).collect()}
    assert a == b and all(0 <= u < 1 for u in a.values()) and sum(a.values()) / 2000 == pytest.approx(0.5, abs=0.03)


def test_wilson_without_trials(spark):
    lo, hi = mathx.wilson(F.lit(0), F.lit(0))
    r = one(spark, lo=lo, hi=hi)
    assert (r.lo, r.hi) == (0.0, 1.0)


def test_iso_round_trip(spark):
    r = one(spark, a=labels.parse_iso(F.lit("2024-01-02T03:04:05Z")), b=labels.parse_iso(F.lit("2024-01-02T03:04:05")),
            c=labels.parse_iso(F.lit("12.5")), d=labels.parse_iso(F.lit("soon")), e=labels.iso_utc(F.lit(1704164645)))
    assert r.a == r.b == 1704164645.0 and r.c == 12.5 and r.d is None and r.e == "2024-01-02T03:04:05Z"
