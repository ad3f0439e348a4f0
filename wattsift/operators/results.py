"""Results as callers see them: summary, zones, pages, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE_ROWS = 500
TOP_ZONES = 5


def with_status(results: DataFrame, status: str) -> DataFrame:
    return results.filter(F.col("status") == F.lit(status))


def in_region(results: DataFrame, region: str) -> DataFrame:
    return results.filter(F.col("region") == F.lit(region))


def _zone_totals(results: DataFrame) -> DataFrame:
    """Everything a summary needs, per region, a missing region included."""
    have = set(results.columns)
    score = F.col("anomaly_score") if "anomaly_score" in have else F.lit(None).cast("double")
    flag = F.col("is_anomaly") if "is_anomaly" in have else F.lit(False)
    status = F.col("status") if "status" in have else F.lit(None).cast("string")
    region = F.col("region") if "region" in have else F.lit(None).cast("string")
    return results.groupBy(region.alias("region")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(flag).alias("flagged"),
        *[F.count_if(status == s).alias(name) for s, name in (
            ("High Risk", "high"), ("Suspicious", "suspicious"), ("Review Needed", "review"))],
        F.count(score).alias("scored"),
        F.sum(score).alias("score_sum"),
        F.max(score).alias("score_max"),
    )


def summary_counts(results: DataFrame) -> DataFrame:
    """One row: the scalar part of the summary."""
    return _totals(_zone_totals(results))


def _totals(zones: DataFrame, *extra: Column) -> DataFrame:
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return zones.agg(
        total("rows").alias("total_consumers"),
        total("flagged").alias("anomalies_detected"),
        total("high").alias("high_risk_count"),
        total("suspicious").alias("suspicious_count"),
        total("review").alias("review_needed_count"),
        F.coalesce(F.try_divide(F.sum("score_sum"), F.sum("scored")), F.lit(0.0)).alias("avg_anomaly_score"),
        F.coalesce(F.max("score_max"), F.lit(0.0)).alias("max_anomaly_score"),
        *extra,
    )


def summarize(results: DataFrame) -> DataFrame:
    """The summary in one row: totals, and the zones with the most flagged consumers.

    A region may be any utility, so the flagged consumers of all zones are rows of their own
    (``zone_flag_counts``). The first zones are a top-k: no task sees a list of regions.
    """
    zones = _zone_totals(results)
    ranked = zones.filter(F.col("region").isNotNull() & (F.col("flagged") > 0)).orderBy(F.desc("flagged"), "region").limit(TOP_ZONES)
    # The zones of the top are marked a second time, with nothing to add up.
    nothing = [F.lit(0).cast(f.dataType).alias(f.name) for f in zones.schema if f.name not in ("region", "flagged")]
    again = ranked.select(F.struct((-F.col("flagged")).alias("rank"), "region").alias("top"), *nothing, F.lit(0).cast("long").alias("flagged"))
    both = zones.select(F.lit(None).cast(again.schema["top"].dataType).alias("top"), *[c for c in again.columns if c != "top"]).unionByName(again)
    full = _totals(both, F.array_sort(F.collect_list("top")).alias("_top"))
    return full.select("*", F.transform("_top", lambda z: z["region"]).alias("high_risk_zones")).drop("_top")


def zone_flag_counts(results: DataFrame) -> DataFrame:
    """Flagged consumers of every region that has any."""
    return (
        results.filter(F.col("region").isNotNull())
        .groupBy("region").agg(F.count_if("is_anomaly").alias("flagged"))
        .filter(F.col("flagged") > 0)
    )


def top_zones(results: DataFrame, n: int = TOP_ZONES) -> DataFrame:
    return zone_flag_counts(results).orderBy(F.desc("flagged"), "region").limit(n)


def zone_statistics(results: DataFrame) -> DataFrame:
    """Consumers, mean score, flagged and flagged share per zone, highest share first."""
    return (
        results.filter(F.col("region").isNotNull())
        .groupBy(F.col("region").alias("zone"))
        .agg(
            F.count("consumer_id").alias("consumer_count"),
            F.round(F.avg("anomaly_score"), 4).alias("avg_anomaly_score"),
            F.count_if("is_anomaly").alias("anomaly_count"),
        )
        .withColumn("anomaly_rate", F.round(F.try_divide("anomaly_count", "consumer_count"), 4))
        .orderBy(F.desc("anomaly_rate"), "zone")
    )


def _order(results: DataFrame, sort_by: str, descending: bool) -> list[Column]:
    order = [F.col("consumer_id")]
    if sort_by in results.columns:
        by = F.col(sort_by)
        order.insert(0, by.desc_nulls_last() if descending else by.asc_nulls_last())
    return order


def sort_results(results: DataFrame, sort_by: str = "anomaly_score", descending: bool = True) -> DataFrame:
    """Sorted with missing values last; an unknown column leaves only the order by consumer."""
    return results.orderBy(*_order(results, sort_by, descending))


def page_of(
    results: DataFrame, sort_by: str = "anomaly_score", descending: bool = True, page: int = 1, limit: int = 50
) -> DataFrame:
    """One page, counted from 1, as a top-k. Many pages, or deep ones, are read from stored results (``sources.pages``)."""
    if page < 1 or limit < 1:
        raise ValueError(f"page and limit start at 1, not {page} and {limit}")
    return sort_results(results, sort_by, descending).offset((page - 1) * limit).limit(limit)


def _or(name: str, default: object, results: DataFrame) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in results.columns else F.lit(default)


def page_rows(results: DataFrame) -> DataFrame:
    """Result rows as a page shows them."""
    return results.select(
        _or("consumer_id", "N/A", results).cast("string").alias("consumer_id"),
        _or("region", "N/A", results).alias("region"),
        F.round(_or("avg_consumption", 0.0, results), 3).alias("avg_consumption"),
        F.round(_or("anomaly_score", 0.0, results), 4).alias("anomaly_score"),
        _or("status", "N/A", results).alias("status"),
        _or("is_anomaly", False, results).alias("is_anomaly"),
        _or("consumption_profile", "Normal", results).alias("consumption_profile"),
    )


def results_page(
    results: DataFrame, page: int = 1, limit: int = 50, status: str | None = None, region: str | None = None,
    sort_by: str = "anomaly_score", descending: bool = True,
) -> DataFrame:
    if not 1 <= limit <= MAX_PAGE_ROWS:
        raise ValueError(f"limit must be 1 to {MAX_PAGE_ROWS}, not {limit}")
    chosen = filtered_results(results, status, region)
    return page_rows(page_of(chosen, sort_by, descending, page, limit))


def filtered_results(results: DataFrame, status: str | None = None, region: str | None = None) -> DataFrame:
    if status:
        results = with_status(results, status)
    if region:
        results = in_region(results, region)
    return results


def page_totals(
    results: DataFrame, limit: int = 50, status: str | None = None, region: str | None = None
) -> DataFrame:
    """One row: rows in all, and pages."""
    return filtered_results(results, status, region).agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(limit)).cast("long"))


def report_rows(results: DataFrame) -> DataFrame:
    """The five columns of a report, rounded."""
    return page_rows(results).select("consumer_id", "region", "avg_consumption", "anomaly_score", "status")


def top_by_score(rows: DataFrame, n: int = 20) -> DataFrame:
    return by_score(rows).limit(n)


def by_score(rows: DataFrame) -> DataFrame:
    return sort_results(rows, "anomaly_score", True)
