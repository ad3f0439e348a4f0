"""Raw model scores to normalised scores, labels and blends. Works on any score column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.fixed_values import AUTOENCODER_WEIGHT, FOREST_WEIGHT
from wattsift.operators.quantiles import exact_quantiles


def check_contamination(contamination: float) -> float:
    if not 0 < contamination <= 0.5:
        raise ValueError(f"contamination must be above 0 and at most 0.5, not {contamination}")
    return float(contamination)


def score_range(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    low, high = df.agg(F.min(column), F.max(column)).first()
    return low, high


def normalized(score: Column, low: float | None, high: float | None, low_is_anomalous: bool) -> Column:
    """Score between 0 and 1, 1 the most anomalous; all 0 when every score is the same."""
    if low is None or high is None or low == high:
        return F.when(score.isNotNull(), F.lit(0.0))
    gap = F.lit(high) - score if low_is_anomalous else score - F.lit(low)
    return gap / F.lit(high - low)


def normalize_scores(df: DataFrame, raw: str, out: str = "anomaly_score", low_is_anomalous: bool = True) -> DataFrame:
    low, high = score_range(df, raw)
    return df.withColumn(out, normalized(F.col(raw), low, high, low_is_anomalous))


def forest_threshold(df: DataFrame, raw: str, contamination: float) -> float | None:
    """Raw score below which a consumer is flagged."""
    return score_statistics(df, raw, contamination)["cut"]


def score_statistics(df: DataFrame, raw: str, contamination: float) -> dict[str, float | None]:
    """``low`` and ``high`` of the raw score, and the ``cut`` below which it is flagged."""
    p = check_contamination(contamination)
    both = {"low": F.min(raw), "high": F.max(raw)}
    return exact_quantiles(df, {"cut": (raw, p)}, also=both)


def label_by_contamination(
    df: DataFrame, raw: str, contamination: float = 0.05, out: str = "is_anomaly"
) -> DataFrame:
    cut = F.lit(forest_threshold(df, raw, contamination)).cast("double")
    return df.withColumn(out, F.coalesce(F.col(raw) < cut, F.lit(False)))


def label_by_threshold(df: DataFrame, score: str, threshold: float, out: str = "is_anomaly") -> DataFrame:
    """Flag normalised scores at or above a threshold of the caller's choice."""
    return df.withColumn(out, F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False)))


def outlier_label(df: DataFrame, raw: str, contamination: float = 0.05) -> DataFrame:
    """``label``: 1 for normal, -1 for flagged."""
    flagged = label_by_contamination(df, raw, contamination, "_flag")
    return flagged.withColumn("label", F.when(F.col("_flag"), -1).otherwise(1)).drop("_flag")


def error_threshold(df: DataFrame, error: str, percentile: float = 95.0) -> float | None:
    return exact_quantiles(df, {"cut": (error, percentile / 100.0)})["cut"]


def label_errors(
    df: DataFrame, error: str, threshold: float | None, score: str = "ae_anomaly_score", out: str = "ae_is_anomaly"
) -> DataFrame:
    """Normalised reconstruction error, and the flag at or above the error threshold."""
    cut = F.lit(threshold).cast("double")
    return normalize_scores(df, error, score, low_is_anomalous=False).withColumn(
        out, F.coalesce(F.col(error) >= cut, F.lit(False)))


def blend(
    forest: Column, autoencoder: Column,
    forest_weight: float = FOREST_WEIGHT, autoencoder_weight: float = AUTOENCODER_WEIGHT,
) -> Column:
    return forest * forest_weight + autoencoder * autoencoder_weight


def blend_scores(
    forest: DataFrame, autoencoder: DataFrame,
    forest_weight: float = FOREST_WEIGHT, autoencoder_weight: float = AUTOENCODER_WEIGHT,
) -> DataFrame:
    """Both scores of every consumer, joined by id, and their blend as ``ensemble_score``.

    ``forest`` has ``consumer_id`` and ``anomaly_score``; ``autoencoder`` has ``consumer_id``
    and ``ae_anomaly_score``.
    """
    mixed = blend(F.col("anomaly_score"), F.col("ae_anomaly_score"), forest_weight, autoencoder_weight)
    return forest.join(autoencoder, "consumer_id").withColumn("ensemble_score", mixed)
