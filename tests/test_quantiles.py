import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattsift.operators import quantiles, radix
from wattsift.operators.quantiles import exact_quantiles

POINTS = [0.0, 0.1, 0.5, 0.7, 0.9, 0.95, 1.0]


def found(spark, data):
    df = spark.createDataFrame([(v,) for v in data], "x double").repartition(5)
    return list(exact_quantiles(df, {f"q{i}": ("x", p) for i, p in enumerate(POINTS)}).values())


@pytest.mark.parametrize("data", [
    [random.Random(1).gauss(0, 1) for _ in range(5000)],
    [random.Random(2).expovariate(1) ** 8 for _ in range(3000)],
    [1.0, 2.0, 3.0, 10.0],
    [7.0],
    [5.0] * 2000 + [6.0],
    [float(i % 3) for i in range(2500)],
    [1.0 + i * 2.0**-52 for i in range(3000)],
    [(-1) ** i * 2.0 ** (i % 600 - 300) for i in range(4000)],
    [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] * 300,
], ids=["normal", "heavy tail", "four", "one", "one value", "three values", "neighbours", "all magnitudes", "extremes"])
def test_quantiles_equal_numpy(spark, data):
    want = [float(np.percentile(data, p * 100)) for p in POINTS]
    assert found(spark, data) == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_infinities_are_values(spark):
    inf = math.inf
    assert found(spark, [-inf, 1.0, 2.0, inf, inf, inf]) == [-inf, -inf, inf, inf, inf, inf, inf]
    assert found(spark, [-inf, 0.0, 1.0])[2] == 0.0


def test_ranks_between_not_a_number_give_none(spark):
    assert found(spark, [1.0, math.nan, math.nan])[-1] is None


def test_nulls_are_ignored_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "x double, y double")
    assert exact_quantiles(df, {"x": ("x", 0.5), "y": ("y", 0.5)}) == {"x": 2.0, "y": None}
    assert exact_quantiles(df.limit(0), {"x": ("x", 0.5)}, {"n": F.sum("x")}) == {"n": None, "x": None}


def test_other_aggregates_come_along(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("x"))
    assert exact_quantiles(df, {"q": ("x", 0.5)}, also={"n": F.sum("x"), "low": F.min("x")}) == {"q": 5.0, "n": 55.0, "low": 0.0}


def test_columns_share_few_passes(spark, monkeypatch):
    passes = []
    counted = quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda df, windows: passes.append(len(windows)) or counted(df, windows))
    df = spark.range(200_000).selectExpr(
        "sqrt(id) * 7 - 100 AS x", "CAST(id % 3 AS DOUBLE) AS few", "IF(id = 7, 1e300, 1.0D * id) AS far", "1 + id * 2e-16D AS close")
    wanted = {f"{c}{i}": (c, p) for c in ("x", "few", "far", "close") for i, p in enumerate((0.0, 0.013, 0.5, 0.9, 1.0))}
    exact = df.agg(*[F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()]).first().asDict()
    assert exact_quantiles(df, wanted) == pytest.approx(exact, rel=1e-13)
    assert passes[0] == 4 and len(passes) <= 4


def test_counts_stay_small_and_hash_aggregate(spark):
    """What a pass brings back is bounded by the digits, and no pass sorts or makes a row of all values."""
    df = spark.range(300_000).selectExpr("CAST(id AS DOUBLE) AS x")
    first = quantiles._counted(df, [("x", radix.magnitude(F.col("x")), None)])
    later = quantiles._counted(df, [("x", radix.step(F.col("x"), 0.0, 299_999.0), (0.0, 299_999.0))])
    assert first.count() < 64 * 19 and later.count() == radix.STEPS
    for pass_ in (first, later):
        plan = pass_._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1


def test_digits_never_fall(spark):
    rng = random.Random(7)
    values = sorted({rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-320, 308) for _ in range(4000)} | {0.0, math.inf, -math.inf})
    values += [2.0**k * (1 + e) for k in (-3, 0, 9) for e in (-2e-16, 0, 3e-16)]
    values.sort()
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", radix.magnitude(F.col("x")).alias("d"))
    digits = [r.d for r in df.orderBy("i").collect()]
    assert digits == sorted(digits) and abs(digits[0]) < 150_000
