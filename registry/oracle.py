"""SQL for DuckDB that gives what the registered queries give, written apart from them."""

from __future__ import annotations

from registry.fixtures import RAW, READINGS, RUNS
from registry.spark_queries import CONTAMINATION, FIRST_READINGS, PAGE, PAGE_ROWS, PLANTED, THRESHOLD
from wattsift import fixed_values as V


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join(
        "(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _zone_rows(zones: dict[str, list[str]]) -> str:
    pairs = [(zone, code) for zone, codes in zones.items() for code in codes]
    return _values([(i, zone, code) for i, (zone, code) in enumerate(pairs)])


MISSING = ", ".join(_text(t) for t in V.MISSING_TEXT)


def _known(column: str, name: str) -> str:
    return f"CASE WHEN trim({column}) IN ({MISSING}) THEN NULL ELSE {column} END AS {name}"


CTE = {
    # raw readings
    "raw": RAW.format(events="events"),
    "named": f"""SELECT {_known('Consumer_ID', 'consumer_id')}, {_known('DateTime', 'timestamp')},
        {_known('KWH', 'consumption')}, {_known('State', 'state')}, {_known('Consumer_Type', 'consumer_type')} FROM raw""",
    "d": "SELECT *, count(*) AS copies FROM named GROUP BY ALL",
    "typed": """SELECT consumer_id, TRY_CAST(timestamp AS TIMESTAMP) AS ts,
        CASE WHEN consumption <> 'Null' THEN TRY_CAST(consumption AS DOUBLE) END AS kwh,
        state, consumer_type, copies FROM d""",
    # clean readings
    "r": f"SELECT * RENAME (reading_ts AS ts) FROM ({READINGS.format(events='events')})",
    "state_codes": f"SELECT * FROM (VALUES {_zone_rows(V.STATE_ZONES)}) AS t(ord, zone, code)",
    "state_map": """SELECT s.state, coalesce(
          (SELECT arg_min(z.zone, z.ord) FROM state_codes z WHERE z.code = s.t),
          (SELECT arg_min(z.zone, z.ord) FROM state_codes z WHERE contains(s.t, z.code) OR contains(z.code, s.t)),
          'Unknown') AS zone
        FROM (SELECT DISTINCT state, upper(trim(state)) AS t FROM r) s""",
    "acorn_codes": f"SELECT * FROM (VALUES {_zone_rows(V.ACORN_ZONES)}) AS t(ord, zone, code)",
    "acorn_map": """SELECT a.acorn_group, coalesce(
          (SELECT arg_min(z.zone, z.ord) FROM acorn_codes z WHERE contains(a.t, lower(z.code))), 'Zone F') AS zone
        FROM (SELECT DISTINCT acorn_group, lower(trim(acorn_group)) AS t FROM r) a""",
    "names": f"SELECT * FROM (VALUES {_values(list(V.STATE_NAMES.items()))}) AS t(code, name)",
    "zr": """SELECT r.*, s.zone AS state_zone, a.zone AS acorn_zone FROM r
        JOIN state_map s ON r.state IS NOT DISTINCT FROM s.state
        JOIN acorn_map a ON r.acorn_group IS NOT DISTINCT FROM a.acorn_group""",
}

# Valid readings out of the raw ones; the raw fixture has two states and readings without one.
CTE["cz"] = """SELECT consumer_id, ts, kwh AS consumption,
    CASE state WHEN 'UP' THEN 'North India' WHEN 'KA' THEN 'South India' ELSE 'Unknown' END AS zone
    FROM typed WHERE kwh >= 0 AND NOT isnan(kwh) AND ts IS NOT NULL AND consumer_id IS NOT NULL"""

AGGREGATE = """SELECT consumer_id, avg(consumption) AS avg_consumption, stddev_samp(consumption) AS std_consumption,
    min(consumption) AS min_consumption, max(consumption) AS max_consumption, sum(consumption) AS total_consumption,
    count(*) AS reading_count, list({zone} ORDER BY ts, {zone})[1] AS region,
    avg(CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 1 ELSE 0 END) AS night_usage_ratio,
    avg(CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END) AS weekend_readings_ratio,
    avg(CASE WHEN hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 18 AND 21 THEN 1 ELSE 0 END) AS peak_usage_ratio
    FROM {source} GROUP BY consumer_id"""
RATIOS = """SELECT *, std_consumption / (avg_consumption + 1e-6) AS cv_consumption,
    max_consumption - min_consumption AS range_consumption,
    (max_consumption - min_consumption) / (avg_consumption + 1e-6) AS range_ratio,
    night_usage_ratio / (1 - night_usage_ratio + 1e-6) AS night_day_ratio,
    weekend_readings_ratio / (1 - weekend_readings_ratio + 1e-6) AS weekend_weekday_ratio,
    1 - peak_usage_ratio AS off_peak_ratio FROM {source}"""
POPULATION = """SELECT avg(avg_consumption) AS mean_avg, quantile_cont(avg_consumption, 0.1) AS q10_avg,
    quantile_cont(avg_consumption, 0.7) AS q70_avg, quantile_cont(avg_consumption, 0.9) AS q90_avg,
    quantile_cont(cv_consumption, 0.9) AS q90_cv, quantile_cont(night_day_ratio, 0.95) AS q95_night FROM {source}"""


FLAGS = """SELECT *, CASE WHEN avg_consumption < (SELECT mean_avg FROM {p}) * 0.3 THEN 1 ELSE 0 END AS low_consumption_flag,
    CASE WHEN cv_consumption > (SELECT q90_cv FROM {p}) THEN 1 ELSE 0 END AS high_variability_flag,
    CASE WHEN night_day_ratio > (SELECT q95_night FROM {p}) THEN 1 ELSE 0 END AS unusual_night_flag FROM {source}"""


def _profile(source: str, typed: bool) -> str:
    kinds = """WHEN upper(consumer_type) = 'COM' OR consumer_type ILIKE '%commercial%' THEN 'Commercial'
        WHEN upper(consumer_type) = 'IND' OR consumer_type ILIKE '%industrial%' THEN 'Industrial'
        WHEN upper(consumer_type) = 'AGR' OR consumer_type ILIKE '%agri%' THEN 'Agricultural Pump'"""
    return f"""CASE WHEN peak_usage_ratio > 0.6 AND avg_consumption > (SELECT q70_avg FROM {source}) THEN 'Summer AC Heavy'
        {kinds if typed else ''}
        WHEN cv_consumption > (SELECT q90_cv FROM {source}) THEN 'Irregular'
        WHEN avg_consumption > (SELECT q90_avg FROM {source}) THEN 'High Consumer'
        WHEN avg_consumption < (SELECT q10_avg FROM {source}) THEN 'Low Consumer'
        WHEN weekend_weekday_ratio > 1.5 THEN 'Weekend Heavy'
        WHEN night_day_ratio > 1.5 THEN 'Night Shifter' ELSE 'Normal' END"""


def _say(avg: str, weekend: str, std: str) -> str:
    q = _text
    return f"""coalesce(nullif(concat_ws(' ',
        CASE WHEN anomaly_score >= 0.9 THEN {q(V.SAY_IRREGULAR)} WHEN anomaly_score >= 0.75 THEN {q(V.SAY_SUSPICIOUS)} END,
        CASE WHEN night_day_ratio > 2 THEN {q(V.SAY_NIGHT_HIGH)} WHEN night_day_ratio < 0.2 THEN {q(V.SAY_NIGHT_LOW)} END,
        CASE WHEN {weekend} > 2 THEN {q(V.SAY_WEEKEND_HIGH)} WHEN {weekend} < 0.3 THEN {q(V.SAY_WEEKEND_LOW)} END,
        CASE WHEN {std} > {avg} * 2 THEN {q(V.SAY_VARIABLE)} END,
        CASE WHEN {avg} < 0.5 THEN {q(V.SAY_LOW)} END), ''), {q(V.SAY_DEFAULT)})"""


def _status(score: str) -> str:
    return f"""CASE WHEN {score} >= 0.9 THEN 'High Risk' WHEN {score} >= 0.75 THEN 'Suspicious'
        WHEN {score} >= 0.5 THEN 'Review Needed' ELSE 'Normal' END"""


CTE |= {
    # consumers by state zone
    "c": AGGREGATE.format(zone="state_zone", source="zr"),
    "f": RATIOS.format(source="c"),
    "p": POPULATION.format(source="f"),
    "fl": FLAGS.format(source="f", p="p"),
    # consumers by ACORN zone, scored by a formula
    "ca": AGGREGATE.format(zone="acorn_zone", source="zr"),
    "fa": RATIOS.format(source="ca"),
    "pa": POPULATION.format(source="fa"),
    "m": "SELECT avg(avg_consumption) AS m, stddev_pop(avg_consumption) AS sd FROM fa",
    "sc": """SELECT fa.*, -(0.3 + 0.7 * abs(avg_consumption - (SELECT m FROM m))
        / (abs(avg_consumption - (SELECT m FROM m)) + (SELECT sd FROM m))) AS raw_score FROM fa""",
    "n": """SELECT *, ((SELECT max(raw_score) FROM sc) - raw_score)
        / ((SELECT max(raw_score) FROM sc) - (SELECT min(raw_score) FROM sc)) AS anomaly_score,
        (std_consumption - (SELECT min(std_consumption) FROM sc))
        / ((SELECT max(std_consumption) FROM sc) - (SELECT min(std_consumption) FROM sc)) AS ae_anomaly_score FROM sc""",
    "res": f"""SELECT *, raw_score < (SELECT quantile_cont(raw_score, {CONTAMINATION}) FROM sc) AS is_anomaly,
        {_status('anomaly_score')} AS status, {_say('0', '1', '0')} AS ai_explanation,
        {_profile('pa', False)} AS consumption_profile FROM n""",
    # consumers out of the raw readings
    "cr": AGGREGATE.format(zone="zone", source="cz"),
    "xr": RATIOS.format(source="cr"),
    "pr": POPULATION.format(source="xr"),
    "flr": FLAGS.format(source="xr", p="pr"),
    # readings against their consumer
    "fr": f"""SELECT r.consumer_id, r.ts, r.consumption AS raw_consumption, round(r.consumption, 4) AS consumption,
        CASE WHEN r.consumption <= 0.005 THEN {_text(V.READING_ZERO)}
             WHEN r.consumption < greatest(0.01, x.avg_consumption * 0.1) THEN {_text(V.READING_LOW)}
             WHEN r.consumption > CASE WHEN x.std_consumption > 0 THEN x.avg_consumption + 3 * x.std_consumption
                  ELSE x.avg_consumption * 3 END THEN {_text(V.READING_SPIKE)}
             WHEN hour(r.ts) BETWEEN 1 AND 5 AND r.consumption > x.avg_consumption * 1.5 THEN {_text(V.READING_NIGHT)}
        END AS anomaly_reason FROM r JOIN ca x USING (consumer_id)""",
    "runs": RUNS.format(orders="orders"),
}

NEEDS = {
    "named": ["raw"], "d": ["named"], "typed": ["d"], "state_map": ["r", "state_codes"],
    "acorn_map": ["r", "acorn_codes"], "zr": ["state_map", "acorn_map"], "c": ["zr"], "f": ["c"], "p": ["f"],
    "fl": ["f", "p"], "ca": ["zr"], "fa": ["ca"], "pa": ["fa"], "m": ["fa"], "sc": ["m"], "n": ["sc"],
    "res": ["n", "pa"], "fr": ["r", "ca"], "cz": ["typed"], "cr": ["cz"], "xr": ["cr"], "pr": ["xr"],
    "flr": ["xr", "pr"],
}


def _sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + body


def _r(*columns: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in columns)


CONSUMER_NUMBERS = [
    "avg_consumption", "std_consumption", "min_consumption", "max_consumption", "total_consumption",
    "night_usage_ratio", "weekend_readings_ratio", "peak_usage_ratio",
]
SUMMARY_FEATURES = [
    *CONSUMER_NUMBERS, "reading_count", "cv_consumption", "range_consumption", "range_ratio", "night_day_ratio",
    "weekend_weekday_ratio", "off_peak_ratio",
]
PAGE_COLUMNS = """consumer_id, region, round(avg_consumption, 3) AS avg_consumption,
    round(anomaly_score, 4) AS anomaly_score, status"""
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END"
TOTALS = """count(*) AS total_consumers, count(*) FILTER (is_anomaly) AS anomalies_detected,
    count(*) FILTER (status = 'High Risk') AS high_risk_count,
    count(*) FILTER (status = 'Suspicious') AS suspicious_count,
    count(*) FILTER (status = 'Review Needed') AS review_needed_count,
    round(avg(anomaly_score) + 1e-9, 6) AS avg_anomaly_score, round(max(anomaly_score) + 1e-9, 6) AS max_anomaly_score"""
ZONE_COUNTS = """(SELECT region, count(*) FILTER (is_anomaly) AS flagged FROM res WHERE region IS NOT NULL
    GROUP BY region HAVING count(*) FILTER (is_anomaly) > 0)"""
DETAIL = """consumer_id, region, round(avg_consumption, 3) AS avg_consumption,
    round(std_consumption, 3) AS std_consumption, round(min_consumption, 3) AS min_consumption,
    round(max_consumption, 3) AS max_consumption, round(anomaly_score, 4) AS anomaly_score, status, is_anomaly,
    consumption_profile, ai_explanation, round(night_day_ratio, 3) AS night_day_ratio,
    round(weekend_weekday_ratio, 3) AS weekend_weekday_ratio, anomalous_record_count, total_records"""
SHOWN = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY consumer_id ORDER BY ts, raw_consumption) AS rn
    FROM fr) WHERE rn <= 500)"""
SHOWN_COUNTS = f"""(SELECT consumer_id, count(*) AS total_records, count(anomaly_reason) AS anomalous_record_count
    FROM {SHOWN} GROUP BY consumer_id)"""


def _vector(template: str) -> str:
    return ", ".join(template.format(c=c) for c in V.MODEL_FEATURES)


CLEAN_REPORT = _sql(
        """SELECT CAST(sum(copies) AS BIGINT) AS original_rows, 5 AS original_columns,
        CAST(sum(copies) - count(*) AS BIGINT) AS removed_duplicates,
        count(*) FILTER (kwh IS NULL) AS removed_nulls, count(*) FILTER (kwh < 0) AS removed_negative,
        count(*) FILTER (kwh >= 0 AND ts IS NULL) AS removed_bad_timestamp,
        count(*) FILTER (kwh >= 0 AND ts IS NOT NULL) AS final_rows,
        round(count(*) FILTER (kwh >= 0 AND ts IS NOT NULL) / sum(copies) + 1e-9, 6) AS cleaning_ratio FROM typed""", "typed")

ORACLE = {
    "standardize_columns": _sql(
        f"SELECT Consumer_ID AS consumer_id, DateTime AS timestamp, KWH AS consumption, State AS state, "
        f"Consumer_Type AS consumer_type, '{V.STATE_LAYOUT}' AS _data_format FROM raw", "raw"),
    "dedup_rows": _sql("SELECT * FROM d", "d"),
    "clean_readings": _sql(
        f"""SELECT consumer_id, CAST(ts AS VARCHAR) AS timestamp, round(kwh + 1e-9, 6) AS consumption, state, consumer_type,
        CASE state WHEN 'UP' THEN 'North India' WHEN 'KA' THEN 'South India' ELSE 'Unknown' END AS region,
        '{V.STATE_LAYOUT}' AS _data_format
        FROM typed WHERE kwh >= 0 AND NOT isnan(kwh) AND ts IS NOT NULL""", "typed"),
    "clean_report": CLEAN_REPORT,
    "analyzed_report": CLEAN_REPORT,
    "zone_from_acorn": _sql(
        "SELECT acorn_group, acorn_zone AS zone, count(*) AS readings FROM zr GROUP BY 1, 2", "zr"),
    "zone_from_state": _sql("SELECT state, state_zone AS zone, count(*) AS readings FROM zr GROUP BY 1, 2", "zr"),
    "state_name": _sql(
        """SELECT state, coalesce(n.name, upper(trim(state)), 'Unknown') AS name, count(*) AS readings
        FROM r LEFT JOIN names n ON n.code = upper(trim(state)) GROUP BY 1, 2""", "r", "names"),
    "region_by_layout": _sql(
        """SELECT state_zone AS state_region, acorn_zone AS acorn_region, 'Unknown' AS bare_state_region,
        'Zone F' AS bare_acorn_region, count(*) AS readings FROM zr GROUP BY 1, 2""", "zr"),
    "time_of_day": _sql(
        """SELECT hour(ts) AS hour, CASE WHEN hour(ts) >= 6 AND hour(ts) < 12 THEN 'morning'
        WHEN hour(ts) >= 12 AND hour(ts) < 18 THEN 'afternoon' WHEN hour(ts) >= 18 AND hour(ts) < 22 THEN 'evening'
        ELSE 'night' END AS part, count(*) AS readings FROM r GROUP BY 1, 2""", "r"),
    "calendar_flags": _sql(
        """SELECT hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, isodow(ts) IN (6, 7) AS is_weekend,
        hour(ts) NOT BETWEEN 6 AND 21 AS is_night, hour(ts) IN (7, 8, 9, 18, 19, 20, 21) AS is_peak,
        count(*) AS readings FROM r GROUP BY ALL""", "r"),
    "format_ts": _sql(
        f"SELECT consumer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS display, {ISO} AS iso FROM r", "r"),
    "consumer_aggregate": _sql(
        f"SELECT consumer_id, {_r(*CONSUMER_NUMBERS)}, reading_count, region FROM c", "c"),
    "dataset_statistics": _sql(
        """SELECT count(*) AS total_consumers, round(avg(avg_consumption) + 1e-9, 6) AS avg_consumption_mean,
        round(stddev_samp(avg_consumption) + 1e-9, 6) AS avg_consumption_std,
        CAST(sum(reading_count) AS BIGINT) AS total_readings FROM c""", "c"),
    "region_counts": _sql("SELECT region, count(*) AS consumers FROM c GROUP BY region", "c"),
    "region_map": _sql("SELECT region, count(*) AS consumers FROM c GROUP BY region", "c"),
    "feature_summary": _sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, round(avg({c}) + 1e-9, 6) AS mean, round(stddev_samp({c}) + 1e-9, 6) AS std,
            round(CAST(min({c}) AS DOUBLE) + 1e-9, 6) AS min, round(CAST(max({c}) AS DOUBLE) + 1e-9, 6) AS max,
            round(median({c}) + 1e-9, 6) AS median FROM f""" for c in SUMMARY_FEATURES), "f"),
    "basic_statistics": _sql(
        """SELECT round(avg(consumption) + 1e-9, 6) AS mean, round(stddev_pop(consumption) + 1e-9, 6) AS std,
        round(min(consumption) + 1e-9, 6) AS min, round(max(consumption) + 1e-9, 6) AS max,
        round(median(consumption) + 1e-9, 6) AS median FROM r""", "r"),
    "variability_features": _sql(
        f"SELECT consumer_id, {_r('cv_consumption', 'range_consumption', 'range_ratio')} FROM f", "f"),
    "behavior_features": _sql(
        f"SELECT consumer_id, {_r('night_day_ratio', 'weekend_weekday_ratio', 'off_peak_ratio')} FROM f", "f"),
    "population_thresholds": _sql(
        "SELECT name, round(value + 1e-9, 6) AS value FROM (UNPIVOT p ON COLUMNS(*) INTO NAME name VALUE value)", "p"),
    "anomaly_flags": _sql(
        "SELECT consumer_id, low_consumption_flag, high_variability_flag, unusual_night_flag FROM fl", "fl"),
    "feature_vector": _sql(
        f"SELECT consumer_id, {_vector('round(CAST(coalesce({c}, 0) AS DOUBLE) + 1e-9, 6) AS {c}')} FROM fl", "fl"),
    "prepare_features": _sql(
        "SELECT consumer_id, " + ", ".join(
            f"round(coalesce({c}, (SELECT avg({c}) FROM c), 0) + 1e-9, 6) AS {c}" for c in V.BASIC_MODEL_FEATURES) + " FROM c",
        "c"),
    "scale_standard": _sql(
        "SELECT consumer_id, " + _vector(
            "round(CASE WHEN (SELECT stddev_pop(coalesce({c}, 0)) FROM fl) = 0 THEN 0.0 ELSE "
            "(coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) FROM fl)) "
            "/ (SELECT stddev_pop(coalesce({c}, 0)) FROM fl) END + 1e-9, 6) AS {c}") + " FROM fl", "fl"),
    "scale_minmax": _sql(
        "SELECT consumer_id, " + _vector(
            "round(CASE WHEN (SELECT max(coalesce({c}, 0)) = min(coalesce({c}, 0)) FROM fl) THEN 0.0 ELSE "
            "(coalesce({c}, 0) - (SELECT min(coalesce({c}, 0)) FROM fl)) * 1.0 "
            "/ (SELECT max(coalesce({c}, 0)) - min(coalesce({c}, 0)) FROM fl) END + 1e-9, 6) AS {c}") + " FROM fl", "fl"),
    "profiles": _sql(f"SELECT consumer_id, {_profile('p', False)} AS consumption_profile FROM f", "f", "p"),
    "profiles_with_type": _sql(
        f"""SELECT consumer_id, consumer_type, {_profile('p', True)} AS consumption_profile FROM f
        JOIN (SELECT consumer_id, max(consumer_type) AS consumer_type FROM r GROUP BY consumer_id) USING (consumer_id)""",
        "f", "p"),
    "reading_flags": _sql(
        """SELECT consumer_id, CAST(ts AS VARCHAR) AS timestamp, round(consumption + 1e-9, 6) AS consumption,
        anomaly_reason IS NOT NULL AS is_anomalous, anomaly_reason FROM fr""", "fr"),
    "anomalous_readings": _sql(
        """SELECT consumer_id, CAST(ts AS VARCHAR) AS timestamp, round(consumption + 1e-9, 6) AS consumption,
        true AS is_anomalous, anomaly_reason FROM fr WHERE anomaly_reason IS NOT NULL""", "fr"),
    "reading_counts": _sql(
        """SELECT consumer_id, count(*) AS total_records, count(anomaly_reason) AS anomalous_record_count
        FROM fr GROUP BY consumer_id""", "fr"),
    "first_n_readings": _sql(
        f"""SELECT consumer_id, CAST(ts AS VARCHAR) AS timestamp, round(consumption + 1e-9, 6) AS consumption
        FROM (SELECT *, row_number() OVER (PARTITION BY consumer_id ORDER BY ts, consumption) AS rn FROM r)
        WHERE rn <= {FIRST_READINGS}""", "r"),
    "consumer_timeseries": _sql(
        """SELECT consumer_id, CAST(ts AS VARCHAR) AS timestamp, round(consumption + 1e-9, 6) AS consumption FROM r
        WHERE consumer_id = (SELECT consumer_id FROM r GROUP BY consumer_id ORDER BY count(*) DESC, consumer_id LIMIT 1)
        ORDER BY ts, consumption""", "r"),
    "stored_readings": _sql(
        """SELECT consumer_id, CAST(ts AS VARCHAR) AS timestamp, round(consumption + 1e-9, 6) AS consumption FROM cz
        WHERE consumer_id = (SELECT consumer_id FROM cz GROUP BY consumer_id ORDER BY count(*) DESC, consumer_id LIMIT 1)
        """, "cz"),
    "consumer_detail": _sql(
        f"SELECT {DETAIL} FROM res JOIN {SHOWN_COUNTS} USING (consumer_id)", "res", "fr"),
    "consumer_detail_records": _sql(
        f"""SELECT consumer_id, {ISO} AS timestamp, consumption, anomaly_reason IS NOT NULL AS is_anomalous,
        anomaly_reason FROM {SHOWN}""", "fr"),
    "drill_down": _sql(
        f"""SELECT {DETAIL} FROM res JOIN {SHOWN_COUNTS} USING (consumer_id)
        ORDER BY res.anomaly_score DESC, consumer_id LIMIT 1""", "res", "fr"),
    "score_range": _sql(
        "SELECT round(min(raw_score) + 1e-9, 6) AS low, round(max(raw_score) + 1e-9, 6) AS high FROM sc", "sc"),
    "score_threshold": _sql(
        f"SELECT round(quantile_cont(raw_score, {CONTAMINATION}) + 1e-9, 6) AS threshold FROM sc", "sc"),
    "normalize_scores": _sql("SELECT consumer_id, round(anomaly_score + 1e-9, 6) AS anomaly_score FROM n", "n"),
    "label_by_contamination": _sql("SELECT consumer_id, is_anomaly FROM res", "res"),
    "outlier_label": _sql("SELECT consumer_id, CASE WHEN is_anomaly THEN -1 ELSE 1 END AS label FROM res", "res"),
    "label_by_threshold": _sql(f"SELECT consumer_id, anomaly_score >= {THRESHOLD} AS is_anomaly FROM n", "n"),
    "label_errors": _sql(
        """SELECT consumer_id, round(ae_anomaly_score + 1e-9, 6) AS ae_anomaly_score,
        std_consumption >= (SELECT quantile_cont(std_consumption, 0.95) FROM sc) AS ae_is_anomaly FROM n""", "n"),
    "blend_scores": _sql(
        f"""SELECT consumer_id, round(anomaly_score + 1e-9, 6) AS anomaly_score, round(ae_anomaly_score + 1e-9, 6) AS ae_anomaly_score,
        round(anomaly_score * 0.6 + ae_anomaly_score * 0.4 + 1e-9, 6) AS ensemble_score,
        {_status('(anomaly_score * 0.6 + ae_anomaly_score * 0.4)')} AS status FROM n""", "n"),
    "status_from_score": _sql("SELECT consumer_id, round(anomaly_score + 1e-9, 6) AS anomaly_score, status FROM res", "res"),
    "status_color": _sql(
        """SELECT status, CASE status WHEN 'High Risk' THEN '#DC2626' WHEN 'Suspicious' THEN '#F59E0B'
        WHEN 'Review Needed' THEN '#3B82F6' WHEN 'Normal' THEN '#10B981' ELSE '#6B7280' END AS color,
        count(*) AS consumers FROM res GROUP BY status""", "res"),
    "explain_reference": _sql("SELECT consumer_id, ai_explanation FROM res", "res"),
    "explain_columns": _sql(
        f"SELECT consumer_id, {_say('avg_consumption', 'weekend_weekday_ratio', 'std_consumption')} AS ai_explanation FROM n",
        "n"),
    "summary_counts": _sql(f"SELECT {TOTALS} FROM res", "res"),
    "summary": _sql(
        f"""SELECT {TOTALS},
        (SELECT string_agg(region, ',' ORDER BY flagged DESC, region) FROM
          (SELECT * FROM {ZONE_COUNTS} ORDER BY flagged DESC, region LIMIT 5)) AS high_risk_zones,
        (SELECT string_agg(region || '=' || flagged, ',' ORDER BY region) FROM {ZONE_COUNTS}) AS zone_anomaly_counts
        FROM res""", "res"),
    "zone_flag_counts": _sql(f"SELECT * FROM {ZONE_COUNTS}", "res"),
    "zone_statistics": _sql(
        """SELECT region AS zone, count(consumer_id) AS consumer_count, round(avg(anomaly_score), 4) AS avg_anomaly_score,
        count(*) FILTER (is_anomaly) AS anomaly_count,
        round(count(*) FILTER (is_anomaly) / count(consumer_id), 4) AS anomaly_rate
        FROM res WHERE region IS NOT NULL GROUP BY region""", "res"),
    "top_zones": _sql(f"SELECT * FROM {ZONE_COUNTS} ORDER BY flagged DESC, region LIMIT 5", "res"),
    "results_page": _sql(
        f"""SELECT {PAGE_COLUMNS}, is_anomaly, consumption_profile FROM res
        ORDER BY res.anomaly_score DESC, consumer_id LIMIT {PAGE_ROWS} OFFSET {(PAGE - 1) * PAGE_ROWS}""", "res"),
    "results_filtered": _sql(
        f"""SELECT {PAGE_COLUMNS}, is_anomaly, consumption_profile FROM res WHERE status = 'Normal' AND region = 'Zone F'
        ORDER BY res.avg_consumption, consumer_id LIMIT 50""", "res"),
    "page_totals": _sql(
        f"""SELECT count(*) AS total, CAST(ceil(count(*) / {PAGE_ROWS}.0) AS BIGINT) AS total_pages
        FROM res WHERE status = 'Normal'""", "res"),
    "top_consumers": _sql(
        f"""SELECT row_number() OVER (ORDER BY res.anomaly_score DESC, consumer_id) AS place, {PAGE_COLUMNS}
        FROM res ORDER BY res.anomaly_score DESC, consumer_id LIMIT 20""", "res"),
    "report_rows": _sql(f"SELECT {PAGE_COLUMNS} FROM res", "res"),
    "report_summary": _sql(
        f"""SELECT 'Total Consumers' AS metric, CAST(count(*) AS VARCHAR) AS value FROM res
        UNION ALL SELECT 'Anomalies Detected', CAST(count(*) FILTER (is_anomaly) AS VARCHAR) FROM res
        UNION ALL SELECT 'High Risk Cases', CAST(count(*) FILTER (status = 'High Risk') AS VARCHAR) FROM res
        UNION ALL SELECT 'Suspicious Cases', CAST(count(*) FILTER (status = 'Suspicious') AS VARCHAR) FROM res
        UNION ALL SELECT 'Average Anomaly Score', printf('%.3f', avg(anomaly_score)) FROM res
        UNION ALL SELECT 'High Risk Zones', (SELECT string_agg(region, ', ' ORDER BY flagged DESC, region) FROM
          (SELECT * FROM {ZONE_COUNTS} ORDER BY flagged DESC, region LIMIT 5))""", "res"),
    "analyzed_consumers": _sql(
        f"""SELECT consumer_id, region, reading_count, {_r(*[c for c in SUMMARY_FEATURES if c != 'reading_count'])},
        low_consumption_flag, high_variability_flag, unusual_night_flag,
        {_profile('pr', False)} AS consumption_profile FROM flr""", "flr", "pr"),
    "forest_shape": _sql(
        """SELECT 100 AS trees, 100 * least(256, count(*)) AS root_rows, 100 * least(256, count(*)) AS leaf_rows,
        false AS too_deep FROM c""", "c"),
    "user_history": _sql(
        """SELECT user_id, analysis_id, filename, total_consumers, used_autoencoder,
        CAST(created_at AS VARCHAR) AS created_at FROM runs
        WHERE user_id = (SELECT user_id FROM runs GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)""", "runs"),
    "run_by_id": _sql(
        """SELECT user_id, analysis_id, filename, total_consumers, used_autoencoder,
        CAST(created_at AS VARCHAR) AS created_at FROM runs ORDER BY runs.created_at DESC, analysis_id LIMIT 1""", "runs"),
    "stored_consumers_page": _sql(
        f"""SELECT 'run-1' AS analysis_ref, consumer_id, region, {_r('avg_consumption', 'anomaly_score')}, status,
        is_anomaly, round(cv_consumption + 1e-9, 6) AS cv_consumption FROM res WHERE status = 'Normal'
        ORDER BY res.anomaly_score DESC, consumer_id LIMIT {PAGE_ROWS} OFFSET {(PAGE - 1) * PAGE_ROWS}""", "res"),
}

ORACLE["deep_page"] = ORACLE["results_page"]
CLEAN = """SELECT DISTINCT Consumer_ID AS consumer_id, CAST(date_trunc('second', ts) AS VARCHAR) AS timestamp,
    round(value + 1e-9, 6) AS consumption, State AS state,
    CASE State WHEN 'UP' THEN 'North India' WHEN 'KA' THEN 'South India' ELSE 'Unknown' END AS region
    FROM (SELECT ts, value, {columns} FROM events)"""
for _form in ("dayfirst", "monthfirst", "named", "compact"):
    ORACLE[f"clean_readings_{_form}"] = CLEAN.format(columns="CAST(user_id AS STRING) AS Consumer_ID, "
        "CASE user_id % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'KA' ELSE NULL END AS State")
ALL_CONSUMERS = "(SELECT count(*) FROM cr)"
# A quantile lies between two scores, so that as many are below it as the whole part of its rank says, and one more.
FLAGGED = "(SELECT CAST(floor((count(*) - 1) * 0.05) AS BIGINT) + 1 FROM {source})"
ORACLE |= {
    "upload_preview_ordered": _sql(
        """SELECT (SELECT count(*) FROM raw) AS rows, 'Consumer_ID,DateTime,KWH,State,Consumer_Type' AS columns, raw.* FROM raw
        ORDER BY Consumer_ID NULLS FIRST, DateTime NULLS FIRST, KWH NULLS FIRST, State NULLS FIRST, Consumer_Type NULLS FIRST
        LIMIT 5""", "raw"),
    "consumer_aggregate_regions": f"""
        SELECT CAST(user_id AS VARCHAR) AS consumer_id, round(stddev_samp(value) + 1e-9, 4) AS std_consumption,
        count(*) AS reading_count, arg_min(CASE event_id % 3 WHEN 0 THEN 'North India' WHEN 1 THEN 'South India'
        ELSE 'West India' END, ts) AS region FROM events GROUP BY user_id""",
    "quantiles_counted": _sql(
        """SELECT name, round(value + 1e-9, 6) AS value FROM (UNPIVOT p ON COLUMNS(*) INTO NAME name VALUE value)
        WHERE name <> 'mean_avg'""", "p"),
    "all_readings_flagged_by_consumer": _sql(
        """SELECT consumer_id, CAST(ts AS VARCHAR) AS timestamp, round(consumption + 1e-9, 6) AS consumption,
        anomaly_reason IS NOT NULL AS is_anomalous, anomaly_reason FROM fr
        WHERE consumer_id = (SELECT consumer_id FROM res ORDER BY anomaly_score DESC, consumer_id LIMIT 1)""", "fr", "res"),
    "stored_consumers_long_page": _sql(
        f"""SELECT consumer_id, {_r('anomaly_score')}, (SELECT count(*) FROM res) AS total FROM res
        ORDER BY res.anomaly_score DESC, consumer_id LIMIT 1000""", "res"),
    "json_round_trip": _sql("SELECT * FROM raw", "raw"),
    "csv_round_trip": _sql("SELECT * REPLACE (nullif(KWH, '') AS KWH) FROM raw", "raw"),
    "csv_malformed": _sql(
        """SELECT * REPLACE (nullif(KWH, '') AS KWH, CASE WHEN KWH LIKE '%3' THEN NULL ELSE Consumer_Type END AS Consumer_Type),
        (SELECT count(*) FROM raw WHERE KWH LIKE '%7') AS removed_malformed FROM raw WHERE KWH IS NULL OR KWH NOT LIKE '%7'""", "raw"),
    **{f"{model}_planted": f"SELECT 'planted-' || k AS consumer_id FROM range(1, {PLANTED + 1}) AS t(k)"
       for model in ("forest", "autoencoder", "analyze", "blend")},
    "labels_round_trip": _sql(
        "SELECT consumer_id AS Consumer_ID, is_anomaly AS Is_Anomaly, status AS Anomaly_Type FROM res", "res"),
    "runs_round_trip": _sql(
        """SELECT 'u1' AS user_id, 'a1' AS analysis_id, 'f.csv' AS filename, count(*) AS total_consumers,
        count(*) FILTER (is_anomaly) AS anomalies_detected, 0.05 AS contamination, count(*) AS stored,
        count(*) FILTER (is_anomaly) AS flagged FROM res""", "res"),
    "forest_importance_uniform": f"""SELECT unnest([{', '.join(_text(c) for c in V.MODEL_FEATURES)}]) AS feature,
        round(1.0 / {len(V.MODEL_FEATURES)} + 1e-9, 6) AS importance""",
    "forest_score_range": _sql("SELECT count(*) AS scores, count(*) AS in_range FROM c", "c"),
    "forest_reload_labels": _sql(
        f"""SELECT count(*) AS consumers, count(*) AS equal_scores, count(*) AS equal_labels,
        {FLAGGED.format(source='c')} AS flagged FROM c""", "c"),
    "autoencoder_parts": _sql(
        f"SELECT count(*) AS errors, count(*) AS valid, {FLAGGED.format(source='c')} AS flagged FROM c", "c"),
    "autoencoder_reload_equal": _sql("SELECT count(*) AS consumers, count(*) AS equal_errors FROM c", "c"),
    "autoencoder_codes": _sql("SELECT consumer_id, 8 AS length, true AS valid FROM c", "c"),
    "analyze_facts": _sql(
        f"""SELECT {ALL_CONSUMERS} AS consumers, {ALL_CONSUMERS} AS in_range, {FLAGGED.format(source='cr')} AS flagged,
        {ALL_CONSUMERS} AS right_status, {ALL_CONSUMERS} AS explained, 0.0 AS low, 1.0 AS high, true AS flags_are_the_top""", "cr"),
    "analyze_with_autoencoder_facts": _sql(
        f"""SELECT {ALL_CONSUMERS} AS consumers, {ALL_CONSUMERS} AS in_range, {FLAGGED.format(source='cr')} AS flagged,
        {ALL_CONSUMERS} AS right_status, {ALL_CONSUMERS} AS explained, {ALL_CONSUMERS} AS blended,
        {ALL_CONSUMERS} AS same_flags""", "cr"),
}
# Where readings are stored must not change what is found.
ORACLE |= {f"{name}_by_day": ORACLE[name] for name in ("reading_flags", "first_n_readings", "consumer_detail")}
