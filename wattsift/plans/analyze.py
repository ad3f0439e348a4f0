"""The whole analysis: raw readings in, scored consumers and their summary out.

The readings are scanned once. Cleaning, its report and the aggregate per consumer come out of
that one job, whose result, one row per consumer, is staged. All later work is on that table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.functions.labels import explanation, status_of
from wattsift.functions.zones import region_of, region_source
from wattsift.operators.autoencoder import (
    Autoencoder, AutoencoderParams, set_threshold, train_autoencoder,
)
from wattsift.operators.cleaning import in_one_order, report_from_counts, tag_readings
from wattsift.operators.consumers import REJECT_COUNTS, aggregate_tagged
from wattsift.operators.features import (
    Population, add_profile, anomaly_flags, fit_population, model_columns, model_inputs, ratio_features,
)
from wattsift.operators.forest import Forest, fit_forest
from wattsift.operators.results import summarize
from wattsift.operators.scaling import fit_scaler
from wattsift.operators.scoring import (
    blend, check_contamination, label_errors, normalized, score_statistics,
)
from wattsift.sources.layouts import detect_layout, rename_standard
from wattsift.sources.runs import new_analysis_id
from wattsift.sources.staging import stage, unstage


@dataclass(frozen=True)
class Analysis:
    analysis_id: str
    contamination: float
    used_autoencoder: bool
    results: DataFrame = field(repr=False)
    summary: DataFrame = field(repr=False)
    cleaning_report: DataFrame = field(repr=False)
    population: Population = field(repr=False)
    forest: Forest = field(repr=False)
    autoencoder: Autoencoder | None = field(repr=False, default=None)
    staged: tuple[DataFrame, ...] = field(repr=False, default=())

    def close(self) -> None:
        """Delete the tables that the results are read from. Save what is wanted before."""
        unstage(*self.staged)


def analyze(
    raw: DataFrame,
    contamination: float = 0.05,
    use_autoencoder: bool = False,
    seed: int = 42,
    bind: str = "defaults",
    autoencoder_params: dict | None = None,
    day_first: bool | None = None,
) -> Analysis:
    """Analyse raw readings in either layout.

    ``day_first`` settles dates like 5/10/2024; without it consumers are counted in both orders, and the dates of the column
    that can only have the day first choose. ``bind="columns"`` lets the explanation use the consumer's own level, weekend ratio and
    deviation; otherwise those sentences work on their fixed defaults.
    """
    check_contamination(contamination)
    if bind not in ("defaults", "columns"):
        raise ValueError(f"bind must be defaults or columns, not {bind}")
    counted = in_one_order(stage(count_consumers(raw, day_first), "consumers"))
    used = F.col("consumer_id").isNotNull() & (F.col("reading_count") > 0)
    readings, rows = counted.agg(F.sum("reading_count"), F.count_if(used)).first()
    if not readings:
        raise ValueError("no valid readings after cleaning")
    if not rows:
        raise ValueError("no consumers after aggregation")

    ratios = ratio_features(counted.filter(used).drop(*REJECT_COUNTS))
    population = fit_population(ratios)
    features = anomaly_flags(ratios, population)
    names, inputs = model_columns(features), model_inputs(features)
    # One scaler serves both models; a forest does not react to scaling.
    scaler = fit_scaler(features, names, inputs)
    scaled = scaler.columns(inputs)
    forest = replace(fit_forest(features, names, scaled, seed=seed, rows=rows), scaler=scaler, contamination=contamination)
    scored, autoencoder = forest.score(features, scaled), None
    if use_autoencoder:
        params = AutoencoderParams(names, seed=seed, **(autoencoder_params or {}))
        autoencoder = train_autoencoder(features, inputs, params, scaler, rows=rows)
        scored = autoencoder.error(scored, inputs)
    scored = stage(scored, "scored")

    found = score_statistics(scored, "raw_score", contamination)
    forest = replace(forest, offset=found["cut"])
    raw_score = F.col("raw_score")
    results = scored.withColumns({
        "anomaly_score": normalized(raw_score, found["low"], found["high"], low_is_anomalous=True),
        "is_anomaly": raw_score < F.lit(found["cut"]),
    })
    if autoencoder is not None:
        # The blend replaces score and status; the flag stays the forest's.
        autoencoder = set_threshold(autoencoder, scored)
        results = label_errors(results, "ae_error", autoencoder.threshold)
        results = results.withColumn("ensemble_score", blend(F.col("anomaly_score"), F.col("ae_anomaly_score")))
        results = results.withColumn("anomaly_score", F.col("ensemble_score"))
    results = results.withColumn("status", status_of(F.col("anomaly_score")))
    own = (F.col("avg_consumption"), F.col("weekend_weekday_ratio"), F.col("std_consumption"))
    ratio = F.col("night_day_ratio") if "night_day_ratio" in results.columns else F.lit(1.0)
    results = results.withColumn(
        "ai_explanation", explanation(F.col("anomaly_score"), ratio, *(own if bind == "columns" else ())))
    results = add_profile(results, population).drop("raw_score", "ae_error")
    return Analysis(
        new_analysis_id(), contamination, use_autoencoder, results, summarize(results),
        report_from_counts(counted, len(raw.columns)), population, forest, autoencoder, (counted, scored),
    )


def count_consumers(raw: DataFrame, day_first: bool | None = None) -> DataFrame:
    """One row per consumer with its aggregate and its cleaning counts.

    Where times are text and ``day_first`` is not given, a row for each order of day and month, of which ``in_one_order`` takes
    one.
    """
    layout = detect_layout(raw.columns)
    columns = rename_standard(raw, layout).columns
    missing = [c for c in ("consumer_id", "consumption") if c not in columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {raw.columns}")
    source = region_source(columns, layout)

    tagged = tag_readings(raw, day_first, by_consumer=True)
    return aggregate_tagged(tagged, source, lambda code: region_of(source, layout, code))
