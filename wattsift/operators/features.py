"""Ratio features, population flags, profiles and model inputs.

Population values (means, quantiles) are fitted once into a handful of numbers and then enter
narrow projections as literals: no join, no shuffle, nothing that grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift import fixed_values as V
from wattsift.functions.parsing import finite, nan_to_null
from wattsift.operators.quantiles import exact_quantiles


def variability_features(consumers: DataFrame) -> DataFrame:
    have = set(consumers.columns)
    base = F.col("avg_consumption") + V.RATIO_EPSILON
    added = {}
    if {"avg_consumption", "std_consumption"} <= have:
        added["cv_consumption"] = nan_to_null(F.try_divide(F.col("std_consumption"), base))
    if {"min_consumption", "max_consumption"} <= have:
        width = F.col("max_consumption") - F.col("min_consumption")
        added["range_consumption"] = nan_to_null(width)
        added["range_ratio"] = nan_to_null(F.try_divide(width, base))
    return consumers.withColumns(added) if added else consumers


def behavior_features(consumers: DataFrame) -> DataFrame:
    def against_rest(share: str) -> Column:
        return F.try_divide(F.col(share), 1 - F.col(share) + V.RATIO_EPSILON)

    recipes = {
        "night_day_ratio": ("night_usage_ratio", against_rest),
        "weekend_weekday_ratio": ("weekend_readings_ratio", against_rest),
        "off_peak_ratio": ("peak_usage_ratio", lambda share: 1 - F.col(share)),
    }
    added = {name: make(share) for name, (share, make) in recipes.items() if share in consumers.columns}
    return consumers.withColumns(added) if added else consumers


def ratio_features(consumers: DataFrame) -> DataFrame:
    return behavior_features(variability_features(consumers))


@dataclass(frozen=True)
class Population:
    """Values over all consumers that flags and profiles compare with; None where unknown."""

    mean_avg: float | None = None
    q10_avg: float | None = None
    q70_avg: float | None = None
    q90_avg: float | None = None
    q90_cv: float | None = None
    q95_night: float | None = None


def fit_population(features: DataFrame) -> Population:
    """All population values in one go; ``features`` should be staged."""
    wanted = {
        "q10_avg": ("avg_consumption", 0.1), "q70_avg": ("avg_consumption", 0.7),
        "q90_avg": ("avg_consumption", 0.9), "q90_cv": ("cv_consumption", 0.9),
        "q95_night": ("night_day_ratio", 0.95),
    }
    wanted = {name: spec for name, spec in wanted.items() if spec[0] in features.columns}
    mean = {"mean_avg": F.avg("avg_consumption")} if "avg_consumption" in features.columns else {}
    return Population(**exact_quantiles(features, wanted, mean)) if wanted else Population()


def _value(number: float | None) -> Column:
    return F.lit(number).cast("double")


def anomaly_flags(features: DataFrame, population: Population) -> DataFrame:
    tests = {
        "low_consumption_flag": ("avg_consumption", lambda c: c < _value(population.mean_avg) * 0.3),
        "high_variability_flag": ("cv_consumption", lambda c: c > _value(population.q90_cv)),
        "unusual_night_flag": ("night_day_ratio", lambda c: c > _value(population.q95_night)),
    }
    added = {
        flag: F.coalesce(test(F.col(column)).cast("int"), F.lit(0))
        for flag, (column, test) in tests.items() if column in features.columns
    }
    return features.withColumns(added) if added else features


def profile(columns: list[str], population: Population) -> Column:
    """Consumption profile: the last rule that applies, else Normal."""
    avg, kind = F.col("avg_consumption"), F.col("consumer_type")
    rules = [
        ("Night Shifter", ["night_day_ratio"], F.col("night_day_ratio") > 1.5),
        ("Weekend Heavy", ["weekend_weekday_ratio"], F.col("weekend_weekday_ratio") > 1.5),
        ("Low Consumer", ["avg_consumption"], avg < _value(population.q10_avg)),
        ("High Consumer", ["avg_consumption"], avg > _value(population.q90_avg)),
        ("Irregular", ["cv_consumption"], F.col("cv_consumption") > _value(population.q90_cv)),
        *[
            (label, ["consumer_type"], (F.upper(kind) == code) | F.lower(kind).contains(word))
            for label, code, word in V.TYPE_PROFILES
        ],
        ("Summer AC Heavy", ["peak_usage_ratio", "avg_consumption"],
         (F.col("peak_usage_ratio") > 0.6) & (avg > _value(population.q70_avg))),
    ]
    usable = [F.when(test, F.lit(label)) for label, needs, test in rules if set(needs) <= set(columns)]
    return F.coalesce(*reversed(usable), F.lit(V.NORMAL))


def add_profile(features: DataFrame, population: Population) -> DataFrame:
    return features.withColumn("consumption_profile", profile(features.columns, population))


def model_columns(df: DataFrame) -> list[str]:
    return [name for name in V.MODEL_FEATURES if name in df.columns]


def model_inputs(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The model's columns as finite doubles, 0 where missing or infinite."""
    return [F.coalesce(finite(F.col(n).cast("double")), F.lit(0.0)).alias(n) for n in names or model_columns(df)]


def feature_vector(df: DataFrame, names: list[str] | None = None) -> Column:
    return F.array(*model_inputs(df, names))


def prepare_basic_features(consumers: DataFrame) -> DataFrame:
    """The basic model features: missing becomes the column mean, then infinities become 0.

    A column that holds an infinity has no finite mean, so its missing values become 0 too.
    """
    names = [n for n in V.BASIC_MODEL_FEATURES if n in consumers.columns]
    means = consumers.agg(*[F.avg(n).alias(n) for n in names]).first().asDict()
    keys = [c for c in ("consumer_id",) if c in consumers.columns]
    return consumers.select(*keys, *[
        F.coalesce(finite(F.coalesce(F.col(n).cast("double"), _value(means[n]))), F.lit(0.0)).alias(n)
        for n in names
    ])
