"""Registered checks: row-wise projections (PRJ-*) and JOIN-05/06."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from verdigris.functions import time as TF
from verdigris.operators import carbon as CO
from verdigris.operators import features as FE
from verdigris.plans import logical as L
from verdigris.plans.catalog import register
from verdigris.plans.cat_timeseries import RECORDS_CO2E_SQL, records_co2e
from verdigris.plans.rounding import r, sql_r


@register("prj01_02_co2e_intensity", "PRJ-01", L.with_ctes(f"""
SELECT record_id, {sql_r('co2e_kg')} AS co2e_kg, {sql_r('carbon_intensity')} AS carbon_intensity FROM rc""",
    rc=RECORDS_CO2E_SQL))
def prj01(spark, d):
    return records_co2e(spark, d).select("record_id", r("co2e_kg").alias("co2e_kg"),
                                         r("carbon_intensity").alias("carbon_intensity"))


RAW_TS_SQL = """
SELECT o_orderkey AS row_id,
       CASE o_orderkey % 4
         WHEN 0 THEN strftime(o_orderdate + INTERVAL (o_orderkey % 720) MINUTE, '%Y-%m-%d %H:%M:%S')
         WHEN 1 THEN strftime(o_orderdate + INTERVAL (o_orderkey % 720) MINUTE, '%Y-%m-%dT%H:%M:%SZ')
         WHEN 2 THEN strftime(o_orderdate + INTERVAL (o_orderkey % 720) MINUTE, '%-m/%-d/%Y %-I:%M %p')
         ELSE o_orderpriority END AS raw_ts
FROM orders"""


def _raw_ts(spark, d):
    o = L.table(spark, d, "orders")
    t = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 720).cast("int"))
    k = F.col("o_orderkey") % 4
    raw = (F.when(k == 0, TF.format_ntz(t, TF.TIMESTAMP_FORMATS[0]))
            .when(k == 1, TF.format_ntz(t, TF.TIMESTAMP_FORMATS[1]))
            .when(k == 2, TF.format_ntz(t, TF.TIMESTAMP_FORMATS[2]))
            .otherwise(F.col("o_orderpriority")))
    return o.select(F.col("o_orderkey").alias("row_id"), raw.alias("raw_ts"))


@register("prj03_multi_format_timestamps", "PRJ-03", L.with_ctes("""
SELECT row_id, coalesce(try_strptime(raw_ts, '%Y-%m-%d %H:%M:%S'), try_strptime(raw_ts, '%Y-%m-%dT%H:%M:%SZ'),
                        try_strptime(raw_ts, '%m/%d/%Y %I:%M %p')) AS ts FROM raw""", raw=RAW_TS_SQL))
def prj03(spark, d):
    return _raw_ts(spark, d).select("row_id", TF.parse_timestamp("raw_ts").alias("ts"))


@register("prj04_normalise_messages", "PRJ-04", L.with_ctes("""
SELECT reading_id, ts, TRY_CAST(value AS DOUBLE) AS value, 'kWh' AS unit,
       coalesce(CASE WHEN kind = 'error' THEN 'error' END, 'ok') AS status,
       CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS meta_size
FROM sf""", sf=L.SENSOR_FEED_SQL))
def prj04(spark, d):
    from verdigris.sources.sensors import normalise_messages
    sf = L.sensor_feed(spark, d)
    msg = sf.select("reading_id", F.to_json(F.struct(
        F.col("ts").cast("string").alias("ts"), F.col("value").cast("string").alias("value"),
        F.lit("kWh").alias("unit"),
        F.when(F.col("kind") == "error", F.lit("error")).alias("status"),
        F.when(F.col("kind") == "purchase", F.create_map(F.lit("channel"), F.lit("web"))).alias("meta")
    )).alias("payload"))
    out = normalise_messages(msg, "payload")
    return out.select("reading_id", "ts", "value", "unit", "status", F.size("meta").alias("meta_size"))


@register("prj05_normalize_reading", "PRJ-05", L.with_ctes("""
SELECT event_id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS kwh FROM events""", ))
def prj05(spark, d):
    from verdigris.sources.sensors import normalize_reading
    e = L.table(spark, d, "events")
    raw = e.select("event_id", F.col("value").cast("string").alias("kwh"), F.lit("220").alias("voltage"),
                   F.lit("ignore").alias("extra_field"))
    return normalize_reading(raw, keep=["event_id"])


def _calib_sql(n):
    return L.with_ctes(f"""
SELECT reading_id, {sql_r('value - b.baseline')} AS calibrated
FROM sf JOIN (SELECT sensor_id, avg(value) AS baseline FROM (
    SELECT sensor_id, value, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, reading_id) AS rn
    FROM sf WHERE value IS NOT NULL) WHERE rn <= {n} GROUP BY sensor_id) b USING (sensor_id)
WHERE value IS NOT NULL""", sf=L.SENSOR_FEED_SQL)


@register("prj06_baseline_first10", "PRJ-06", _calib_sql(10))
def prj06(spark, d):
    from verdigris.sources.sensors import calibrate_baseline
    sf = L.sensor_feed(spark, d).filter(F.col("value").isNotNull())
    out = calibrate_baseline(sf, "value", key="sensor_id", n=10, tiebreak="reading_id")
    return out.select("reading_id", r("calibrated").alias("calibrated"))


@register("prj07_zero_offset_first1000", "PRJ-07", _calib_sql(1000))
def prj07(spark, d):
    from verdigris.sources.sensors import calibrate_baseline
    sf = L.sensor_feed(spark, d).filter(F.col("value").isNotNull())
    out = calibrate_baseline(sf, "value", key="sensor_id", n=1000, tiebreak="reading_id")
    return out.select("reading_id", r("calibrated").alias("calibrated"))


@register("prj08_calendar_features", "PRJ-08", L.with_ctes("""
SELECT ts, facility_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day, month(ts) AS month,
       isodow(ts) - 1 >= 5 AS is_weekend FROM em""", em=L.EMISSION_METRICS_SQL))
def prj08(spark, d):
    out = FE.calendar_features(L.emission_metrics(spark, d))
    return out.select("ts", "facility_id", "hour", "day_of_week", "day", "month", "is_weekend")


# A small holiday calendar used by the holiday-flag check.
HOLIDAYS = [("US", "2024-01-01"), ("US", "2024-01-15"), ("DE", "2024-01-01"), ("GB", "2024-01-01")]


def holidays_frame(spark):
    return spark.createDataFrame(HOLIDAYS, "country string, d string").select(
        "country", F.to_date("d").alias("date"))


HOLIDAYS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS country, DATE '{x}' AS date" for c, x in HOLIDAYS)


@register("prj09_holiday_flag", "PRJ-09", L.with_ctes("""
SELECT ts, facility_id, CAST(ts AS DATE) IN (SELECT date FROM hol WHERE country = 'US') AS is_holiday
FROM em""", em=L.EMISSION_METRICS_SQL, hol=HOLIDAYS_SQL))
def prj09(spark, d):
    out = FE.holiday_flag(L.emission_metrics(spark, d), holidays_frame(spark), "US")
    return out.select("ts", "facility_id", "is_holiday")


@register("prj10_cyclical_hour", "PRJ-10", L.with_ctes(f"""
SELECT ts, facility_id, {sql_r(f'sin(2 * {math.pi!r} * hour(ts) / 24)')} AS hour_sin,
       {sql_r(f'cos(2 * {math.pi!r} * hour(ts) / 24)')} AS hour_cos FROM em""", em=L.EMISSION_METRICS_SQL))
def prj10(spark, d):
    out = FE.cyclical_hour(L.emission_metrics(spark, d))
    return out.select("ts", "facility_id", r("hour_sin").alias("hour_sin"), r("hour_cos").alias("hour_cos"))


@register("prj11_log1p", "PRJ-11", L.with_ctes(f"""
SELECT ts, facility_id, {sql_r('ln(1 + co2_kg)')} AS co2_kg, {sql_r('ln(1 + anomaly_score)')} AS anomaly_score
FROM em""", em=L.EMISSION_METRICS_SQL))
def prj11(spark, d):
    out = FE.log1p_columns(L.emission_metrics(spark, d), ["co2_kg", "anomaly_score"])
    return out.select("ts", "facility_id", r("co2_kg").alias("co2_kg"), r("anomaly_score").alias("anomaly_score"))


def _fourier_sql():
    cols = []
    for p in (24, 168):
        for k in range(1, 4):
            arg = f"2 * {math.pi!r} * {k} * (epoch_us(ts) / 3600000000.0) / {p}"
            cols.append(f"{sql_r(f'sin({arg})')} AS fourier_sin_{p}_{k}")
            cols.append(f"{sql_r(f'cos({arg})')} AS fourier_cos_{p}_{k}")
    return L.with_ctes(f"SELECT ts, facility_id, {', '.join(cols)} FROM em", em=L.EMISSION_METRICS_SQL)


@register("prj12_fourier_features", "PRJ-12", _fourier_sql())
def prj12(spark, d):
    out = FE.fourier_features(L.emission_metrics(spark, d).select("ts", "facility_id"))
    return out.select("ts", "facility_id", *[r(c).alias(c) for c in out.columns if c.startswith("fourier")])


# The scenarios of the what-if check (name, efficiency, renewable).
SCENARIOS = [("efficiency-15", 0.15, 0.0), ("renewable-40", 0.0, 0.4), ("both", 0.15, 0.4)]
SCENARIOS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, {e} AS efficiency, {x} AS renewable"
                                   for n, e, x in SCENARIOS)
BASE_CASES_SQL = f"""
SELECT coalesce(e.facility_id, w.facility_id) AS facility_id, coalesce(e.energy_usage, 0.0) AS energy_usage,
       coalesce(w.water_usage, 0.0) AS water_usage
FROM (SELECT facility_id, sum(kwh) AS energy_usage FROM ({L.ENERGY_USAGE_SQL}) GROUP BY 1) e
FULL JOIN (SELECT facility_id, sum(cubic_meters) AS water_usage FROM ({L.WATER_USAGE_SQL}) GROUP BY 1) w
USING (facility_id)"""


def base_cases(spark, d):
    e = L.energy_usage(spark, d).groupBy("facility_id").agg(F.sum("kwh").alias("energy_usage"))
    w = L.water_usage(spark, d).groupBy("facility_id").agg(F.sum("cubic_meters").alias("water_usage"))
    return e.join(w, "facility_id", "full").select(
        "facility_id", F.coalesce("energy_usage", F.lit(0.0)).alias("energy_usage"),
        F.coalesce("water_usage", F.lit(0.0)).alias("water_usage"))


@register("prj13_join06_scenarios", "PRJ-13", L.with_ctes(f"""
SELECT facility_id, 'base' AS scenario, {sql_r('energy_usage')} AS energy_usage, {sql_r('water_usage')} AS water_usage
FROM bc
UNION ALL
SELECT facility_id, name AS scenario,
       {sql_r('CASE WHEN renewable > 0 THEN energy_usage * (1 - efficiency) * (1 - 0.3 * renewable) ELSE energy_usage * (1 - efficiency) END')} AS energy_usage,
       {sql_r('water_usage * (1 - efficiency)')} AS water_usage
FROM bc CROSS JOIN sc""", bc=BASE_CASES_SQL, sc=SCENARIOS_SQL))
def prj13(spark, d):
    out = CO.scenario_analysis(base_cases(spark, d), SCENARIOS)
    return out.select("facility_id", "scenario", r("energy_usage").alias("energy_usage"),
                      r("water_usage").alias("water_usage"))


@register("prj13_many_scenarios", "PRJ-13", L.with_ctes(f"""
SELECT scenario, count(*) AS n, {sql_r('sum(e)')} AS energy_usage FROM (
  SELECT 'base' AS scenario, energy_usage AS e FROM bc
  UNION ALL SELECT 's' || CAST(c_custkey AS VARCHAR), energy_usage * (1 - (c_custkey % 100) / 100.0) FROM bc CROSS JOIN customer)
GROUP BY 1""", bc=BASE_CASES_SQL))
def prj13_many(spark, d):
    sc = L.table(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("name"),
                                              (F.col("c_custkey") % 100 / 100.0).alias("efficiency"), F.lit(0.0).alias("renewable"))
    out = CO.scenario_totals(base_cases(spark, d), sc)
    return out.select("scenario", "n", r("energy_usage").alias("energy_usage"))


@register("prj15_wei_exact", "PRJ-15", L.with_ctes("""
SELECT o_orderkey, CAST(w // 1000000000000000000::HUGEINT AS VARCHAR) || '.' ||
       lpad(CAST(w % 1000000000000000000::HUGEINT AS VARCHAR), 18, '0') AS credits
FROM (SELECT o_orderkey, o_orderkey::HUGEINT * 1234567890123456789::HUGEINT + 1 AS w FROM orders)"""))
def prj15_exact(spark, d):
    from verdigris.functions.carbon import from_wei
    wei = F.col("o_orderkey").cast("decimal(18,0)") * F.lit(1234567890123456789).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
    return L.table(spark, d, "orders").select("o_orderkey", from_wei(wei).cast("string").alias("credits"))


@register("prj14_prediction_interval", "PRJ-14", L.with_ctes("""
SELECT facility_id, round(avg(co2_kg) - 1.96 * stddev_pop(co2_kg), 2) AS lower_bound,
       round(avg(co2_kg) + 1.96 * stddev_pop(co2_kg), 2) AS upper_bound FROM em GROUP BY 1""",
    em=L.EMISSION_METRICS_SQL))
def prj14(spark, d):
    s = L.emission_metrics(spark, d).groupBy("facility_id").agg(
        F.avg("co2_kg").alias("prediction"), F.stddev_pop("co2_kg").alias("sigma"))
    return CO.with_interval(s).select("facility_id", "lower_bound", "upper_bound")


@register("prj15_token_units", "PRJ-15", L.with_ctes("""
SELECT seq, CAST(amount_wei AS VARCHAR) AS amount_wei,
       CAST(CAST(o_totalprice AS DECIMAL(38,2)) * CAST(1000000000000000000 AS DECIMAL(38,0)) AS DECIMAL(38,0)) = amount_wei AS round_trip_ok
FROM ce JOIN orders ON seq = o_orderkey""", ce=L.CREDIT_EVENTS_SQL))
def prj15(spark, d):
    from verdigris.functions.carbon import to_wei
    ce = L.credit_events(spark, d)
    o = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"),
                                           F.col("o_totalprice").cast("decimal(38,2)").alias("credits"))
    j = ce.join(o, "seq")
    return j.select("seq", F.col("amount_wei").cast("string").alias("amount_wei"),
                    (to_wei("credits") == F.col("amount_wei")).alias("round_trip_ok"))


ERROR_TEXT_SQL = """
SELECT seq, CASE kind WHEN 'mint' THEN 'AccessControl: caller is not owner or minter'
                      WHEN 'transfer' THEN 'execution reverted: ERC20: Transfer to Zero Address'
                      ELSE 'ERC1155: insufficient balance for transfer' END AS raw_error FROM ce"""


@register("prj16_classify_contract_errors", "PRJ-16", L.with_ctes("""
SELECT seq, CASE WHEN contains(lower(raw_error), 'insufficient balance') THEN 'Insufficient carbon credit balance'
                 WHEN contains(lower(raw_error), 'transfer to zero address') THEN 'Invalid recipient address'
                 WHEN contains(lower(raw_error), 'caller is not owner') THEN 'Unauthorized mint operation'
                 ELSE 'Blockchain contract error occurred' END AS message FROM et""",
    ce=L.CREDIT_EVENTS_SQL, et=ERROR_TEXT_SQL))
def prj16(spark, d):
    from verdigris.operators.ledger import classify_contract_error
    ce = L.credit_events(spark, d)
    et = ce.select("seq", F.when(F.col("kind") == "mint", "AccessControl: caller is not owner or minter")
                   .when(F.col("kind") == "transfer", "execution reverted: ERC20: Transfer to Zero Address")
                   .otherwise("ERC1155: insufficient balance for transfer").alias("raw_error"))
    return et.select("seq", classify_contract_error("raw_error").alias("message"))


@register("prj17_json_field_access", "PRJ-17", L.with_ctes("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""))
def prj17(spark, d):
    e = L.table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@register("prj17_facility_location", "PRJ-17", L.with_ctes("""
SELECT facility_id, nation, region FROM fac""", fac=L.FACILITIES_SQL))
def prj17b(spark, d):
    f = L.facilities(spark, d)
    j = f.select("facility_id", F.to_json("location").alias("loc_json"))
    return j.select("facility_id", F.get_json_object("loc_json", "$.nation").alias("nation"),
                    F.get_json_object("loc_json", "$.region").alias("region"))


@register("prj19_abs_error", "PRJ-19", L.with_ctes(f"""
SELECT ts, facility_id, {sql_r('abs(co2_kg - avg(co2_kg) OVER (PARTITION BY facility_id))')} AS abs_error
FROM em""", em=L.EMISSION_METRICS_SQL))
def prj19(spark, d):
    em = L.emission_metrics(spark, d)
    m = em.groupBy("facility_id").agg(F.avg("co2_kg").alias("predicted"))
    out = CO.abs_error(em.join(m, "facility_id").withColumnRenamed("co2_kg", "actual"))
    return out.select("ts", "facility_id", r("abs_error").alias("abs_error"))


@register("prj20_prediction_ids", "PRJ-20", L.with_ctes("""
SELECT ts, facility_id, day, 'pred_' || substr(sha256(CAST(facility_id AS VARCHAR) || '|' || CAST(day AS VARCHAR)), 1, 16) AS prediction_id
FROM (SELECT ts, facility_id, CAST(ts AS DATE) AS day FROM em)""", em=L.EMISSION_METRICS_SQL))
def prj20(spark, d):
    em = L.emission_metrics(spark, d).select("ts", "facility_id", F.to_date("ts").alias("day"))
    return CO.prediction_ids(em, ["facility_id", "day"])


# Validity-dated CO2e factors per source type (code, factor, from, to).
CATEGORIES = [("AF", 1.10, "1990-01-01", "1998-01-01"), ("AF", 1.05, "1998-01-01", None),
              ("NF", 0.95, "1990-01-01", None), ("NO", 1.00, "1990-01-01", "2000-01-01"),
              ("RF", 1.20, "1990-01-01", None)]


def categories_frame(spark):
    return spark.createDataFrame(CATEGORIES, "category_code string, co2e_factor double, f string, t string").select(
        "category_code", "co2e_factor", F.to_timestamp_ntz("f").alias("effective_from"),
        F.to_timestamp_ntz("t").alias("effective_to"))


CATEGORIES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS category_code, CAST({f} AS DOUBLE) AS co2e_factor, TIMESTAMP '{a} 00:00:00' AS effective_from, "
    + (f"TIMESTAMP '{b} 00:00:00'" if b else "CAST(NULL AS TIMESTAMP)") + " AS effective_to"
    for c, f, a, b in CATEGORIES)


@register("join05_validity_dated_factor", "JOIN-05", L.with_ctes("""
SELECT r.record_id, c.co2e_factor FROM rc r LEFT JOIN cat c
  ON r.source_type = c.category_code AND r.ts >= c.effective_from
 AND (c.effective_to IS NULL OR r.ts < c.effective_to)""", rc=L.EMISSION_RECORDS_SQL, cat=CATEGORIES_SQL))
def join05(spark, d):
    out = CO.factor_lookup(L.emission_records(spark, d), categories_frame(spark))
    return out.select("record_id", "co2e_factor")


DAILY_FACTORS_SQL = """
SELECT 'NO' AS category_code, 1 + (date_diff('day', DATE '1990-01-01', day) % 97) / 97.0 AS co2e_factor,
       day + INTERVAL 12 HOUR AS effective_from, day + INTERVAL 36 HOUR AS effective_to
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
UNION ALL SELECT 'AF', 2.5, TIMESTAMP '1994-06-01 00:00:00', NULL
UNION ALL SELECT 'RF', 0.5, TIMESTAMP '1992-01-01 00:00:00', TIMESTAMP '1993-03-01 00:00:00'
UNION ALL SELECT 'RF', 0.75, TIMESTAMP '1993-01-01 00:00:00', TIMESTAMP '1996-01-01 00:00:00'"""


def daily_factors(spark, d):
    """A factor for each day of one category, from noon to noon; a category
    with an open version and one with versions that overlap."""
    days = L.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    at = F.col("day").cast("timestamp_ntz")
    hot = days.select(F.lit("NO").alias("category_code"),
                      (1 + (F.datediff("day", F.lit("1990-01-01").cast("date")) % 97) / 97.0).alias("co2e_factor"),
                      (at + F.expr("INTERVAL 12 HOURS")).alias("effective_from"), (at + F.expr("INTERVAL 36 HOURS")).alias("effective_to"))
    t = dt.datetime
    rest = spark.createDataFrame([("AF", 2.5, t(1994, 6, 1), None), ("RF", 0.5, t(1992, 1, 1), t(1993, 3, 1)),
                                  ("RF", 0.75, t(1993, 1, 1), t(1996, 1, 1))],
                                 "category_code string, co2e_factor double, effective_from timestamp_ntz, effective_to timestamp_ntz")
    return hot.unionByName(rest)


@register("join05_daily_factors", "JOIN-05", L.with_ctes(f"""
SELECT r.record_id, r.at, {sql_r('c.co2e_factor')} AS co2e_factor
FROM (SELECT record_id, source_type, ts + (order_key % 24) * INTERVAL 1 HOUR AS at FROM rc) r
LEFT JOIN cat c ON r.source_type = c.category_code AND r.at >= c.effective_from
 AND (c.effective_to IS NULL OR r.at < c.effective_to)""", rc=L.EMISSION_RECORDS_SQL, cat=DAILY_FACTORS_SQL))
def join05_daily(spark, d):
    rc = L.emission_records(spark, d)
    at = F.timestamp_add("HOUR", (F.col("order_key") % 24).cast("int"), F.col("ts").cast("timestamp_ntz"))
    out = CO.factor_lookup(rc.select("record_id", "source_type", at.alias("at")), daily_factors(spark, d), ts="at")
    return out.select("record_id", "at", r("co2e_factor").alias("co2e_factor"))


@register("prj18_protect_reveal_payload", "PRJ-18", L.with_ctes("""
SELECT event_id, props AS raw_data FROM events"""))
def prj18(spark, d):
    from verdigris.operators.tables import protect_column, reveal_column
    key = "000102030405060708090a0b0c0d0e0f"
    e = L.table(spark, d, "events").select("event_id", F.col("props").alias("raw_data"))
    return reveal_column(protect_column(e, "raw_data", key), "raw_data", key)
