"""Scores and values to labels and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattsift import fixed_values as V
from wattsift.functions.parsing import literal_map


def status_of(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= cut, F.lit(name)) for name, cut in V.STATUS_CUTOFFS], F.lit(V.NORMAL))


def status_color(status: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(V.STATUS_COLORS), status), F.lit(V.DEFAULT_COLOR))


def explanation(
    score: Column,
    night_day_ratio: Column,
    avg_usage: Column | None = None,
    weekend_ratio: Column | None = None,
    std_deviation: Column | None = None,
) -> Column:
    """Sentences that apply to a consumer, joined by blanks.

    The last three arguments stand at 0, 1 and 0 unless given.
    """
    avg = F.lit(0.0) if avg_usage is None else avg_usage
    weekend = F.lit(1.0) if weekend_ratio is None else weekend_ratio
    std = F.lit(0.0) if std_deviation is None else std_deviation
    said = F.concat_ws(
        " ",
        F.when(score >= 0.9, V.SAY_IRREGULAR).when(score >= 0.75, V.SAY_SUSPICIOUS),
        F.when(night_day_ratio > 2, V.SAY_NIGHT_HIGH).when(night_day_ratio < 0.2, V.SAY_NIGHT_LOW),
        F.when(weekend > 2, V.SAY_WEEKEND_HIGH).when(weekend < 0.3, V.SAY_WEEKEND_LOW),
        F.when(std > avg * 2, V.SAY_VARIABLE),
        F.when(avg < 0.5, V.SAY_LOW),
    )
    return F.when(said == "", V.SAY_DEFAULT).otherwise(said)


def reading_reason(consumption: Column, ts: Column, avg: Column, std: Column) -> Column:
    """Why one reading stands out against its consumer's own level; NULL when it does not."""
    usual = F.coalesce(avg, F.lit(0.0))
    low = F.greatest(F.lit(V.LOWEST_LOW_THRESHOLD), usual * 0.1)
    high = F.when(std > 0, usual + 3 * std).otherwise(usual * 3)
    return (
        F.when(consumption <= V.ZERO_READING, V.READING_ZERO)
        .when(consumption < low, V.READING_LOW)
        .when(consumption > high, V.READING_SPIKE)
        .when(F.hour(ts).between(1, 5) & (consumption > usual * 1.5), V.READING_NIGHT)
    )
