"""Registered checks: monitoring, reports and combined metrics (AGG-06..10,
AGG-13..16, AGG-19, JOIN-03, JOIN-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import monitor as MO
from verdigris.operators import reports as RP
from verdigris.operators.series import apply_framed
from verdigris.operators.joins import combined_metrics, with_facility, with_owner
from verdigris.plans import logical as L
from verdigris.plans.catalog import register
from verdigris.plans.cat_timeseries import RECORDS_CO2E_SQL, records_co2e
from verdigris.plans.rounding import r, sql_r


def predictions(spark, d):
    """Two baseline 'models' over emission metrics: v1 = facility mean,
    v2 = previous reading of the facility."""
    em = L.emission_metrics(spark, d)
    v1 = em.join(em.groupBy("facility_id").agg(F.avg("co2_kg").alias("predicted")), "facility_id").select(
        "ts", "facility_id", F.lit("v1").alias("model_version"), F.col("co2_kg").alias("actual"), "predicted")
    lagged = apply_framed(em.select("ts", "facility_id", F.col("co2_kg").alias("actual")), "facility_id", [F.col("ts").asc()],
                          lambda w: [F.lag("actual").over(w).alias("predicted")], back=1)
    v2 = lagged.select("ts", "facility_id", F.lit("v2").alias("model_version"), "actual", "predicted")
    return v1.unionByName(v2)


PREDICTIONS_SQL = f"""
SELECT ts, facility_id, 'v1' AS model_version, co2_kg AS actual, avg(co2_kg) OVER (PARTITION BY facility_id) AS predicted
FROM ({L.EMISSION_METRICS_SQL})
UNION ALL
SELECT ts, facility_id, 'v2', co2_kg, lag(co2_kg) OVER (PARTITION BY facility_id ORDER BY ts)
FROM ({L.EMISSION_METRICS_SQL})"""


@register("agg09_batch_summary", "AGG-09", L.with_ctes("""
SELECT round(avg(v), 2) AS mean, round(stddev_pop(v), 2) AS std_dev, round(sum(v), 2) AS total,
       round(min(v), 2) AS min, round(max(v), 2) AS max
FROM (SELECT round(predicted, 2) AS v FROM pr)""", pr=PREDICTIONS_SQL))
def agg09(spark, d):
    return MO.batch_summary(predictions(spark, d), "predicted")


@register("agg10_processed_failed", "AGG-10", L.with_ctes("""
SELECT count_if(predicted IS NOT NULL) AS processed, count_if(predicted IS NULL) AS failed
FROM pr""", pr=PREDICTIONS_SQL))
def agg10(spark, d):
    return MO.processed_failed(predictions(spark, d), "predicted")


@register("agg13_forecast_accuracy", "AGG-13", L.with_ctes("""
SELECT coalesce(round(greatest(0.0, 100.0 - avg(abs(anomaly_score - p)) * 100), 1), 0.0) AS accuracy
FROM (SELECT anomaly_score, avg(anomaly_score) OVER (PARTITION BY facility_id) AS p FROM em)""",
    em=L.EMISSION_METRICS_SQL))
def agg13(spark, d):
    em = L.emission_metrics(spark, d)
    m = em.groupBy("facility_id").agg(F.avg("anomaly_score").alias("predicted"))
    return MO.forecast_accuracy(em.join(m, "facility_id").withColumnRenamed("anomaly_score", "actual"))


def _metrics_sql(where: str, group: bool):
    key = "model_version, " if group else ""
    return f"""
SELECT {key}{sql_r('avg(abs(actual - predicted))')} AS mae, {sql_r('avg((actual - predicted) * (actual - predicted))')} AS mse,
       {sql_r('sqrt(avg((actual - predicted) * (actual - predicted)))')} AS rmse,
       {sql_r('1 - sum((actual - predicted) * (actual - predicted)) / nullif(var_pop(actual) * count(actual), 0)')} AS r2,
       count(*) AS n
FROM pr WHERE {where}{' GROUP BY model_version' if group else ''}"""


@register("agg14_regression_metrics", "AGG-14", L.with_ctes(_metrics_sql("predicted IS NOT NULL", False),
                                                              pr=PREDICTIONS_SQL))
def agg14(spark, d):
    m = MO.regression_metrics(predictions(spark, d).filter(F.col("predicted").isNotNull()))
    return m.select(*[r(c).alias(c) for c in ("mae", "mse", "rmse", "r2")], "n")


@register("agg15_metrics_by_version", "AGG-15", L.with_ctes(f"""
SELECT m.*, l.last_prediction FROM ({_metrics_sql("predicted IS NOT NULL AND ts > (SELECT max(ts) FROM pr) - INTERVAL 7 DAY", True)}) m
JOIN (SELECT model_version, max(ts) AS last_prediction FROM pr WHERE predicted IS NOT NULL
        AND ts > (SELECT max(ts) FROM pr) - INTERVAL 7 DAY GROUP BY 1) l USING (model_version)""",
    pr=PREDICTIONS_SQL))
def agg15(spark, d):
    p = predictions(spark, d).filter(F.col("predicted").isNotNull())
    m = MO.metrics_by_version(p, days=7)
    return m.select("model_version", *[r(c).alias(c) for c in ("mae", "mse", "rmse", "r2")], "n", "last_prediction")


def _drift_sql(aligned: bool):
    split = "TIMESTAMP '2024-01-16 00:00:00'"
    if aligned:
        bins = """least(10, greatest(1, CAST(floor((co2_kg - lo) / (hi - lo) * 10) AS INTEGER) + 1))"""
        return L.with_ctes(f"""
SELECT {sql_r('coalesce(sum(CASE WHEN p <> 0 THEN p * ln(p / greatest(coalesce(q, 0.0), 0.000001)) END), 0.0)')} AS kl_divergence,
       coalesce(sum(CASE WHEN p <> 0 THEN p * ln(p / greatest(coalesce(q, 0.0), 0.000001)) END), 0.0) > 0.15 AS drift_detected
FROM (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM (SELECT {bins} AS bin FROM ref, rng) GROUP BY bin) a
FULL JOIN (SELECT bin, count(*) / sum(count(*)) OVER () AS q FROM (SELECT {bins} AS bin FROM cur, rng) GROUP BY bin) b
USING (bin)""", em=L.EMISSION_METRICS_SQL, ref=f"SELECT co2_kg FROM em WHERE ts < {split}",
                           cur=f"SELECT co2_kg FROM em WHERE ts >= {split}",
                           rng="SELECT min(co2_kg) AS lo, max(co2_kg) AS hi FROM ref")
    bins = """least(10, greatest(1, CAST(floor((co2_kg - lo) / (hi - lo) * 10) AS INTEGER) + 1))"""
    dens = "count(*) / (sum(count(*)) OVER () * ((max(hi) - max(lo)) / 10))"
    return L.with_ctes(f"""
SELECT {sql_r('coalesce(sum(CASE WHEN p <> 0 THEN p * ln(p / q) END), 0.0)')} AS kl_divergence,
       coalesce(sum(CASE WHEN p <> 0 THEN p * ln(p / q) END), 0.0) > 0.15 AS drift_detected
FROM (SELECT bin, {dens} AS p FROM (SELECT {bins} AS bin, lo, hi FROM ref, (SELECT min(co2_kg) lo, max(co2_kg) hi FROM ref)) GROUP BY bin) a
FULL JOIN (SELECT bin, {dens} AS q FROM (SELECT {bins} AS bin, lo, hi FROM cur, (SELECT min(co2_kg) lo, max(co2_kg) hi FROM cur)) GROUP BY bin) b
USING (bin)""", em=L.EMISSION_METRICS_SQL, ref=f"SELECT co2_kg FROM em WHERE ts < {split}",
                       cur=f"SELECT co2_kg FROM em WHERE ts >= {split}")


def _drift(spark, d, aligned):
    em = L.emission_metrics(spark, d)
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    out = MO.drift(em.filter(F.col("ts") < split), em.filter(F.col("ts") >= split), "co2_kg", aligned=aligned)
    return out.select(r("kl_divergence").alias("kl_divergence"), "drift_detected")


@register("agg16_drift_aligned", "AGG-16", _drift_sql(True))
def agg16(spark, d):
    return _drift(spark, d, True)


@register("agg16_drift_literal", "AGG-16", _drift_sql(False))
def agg16l(spark, d):
    return _drift(spark, d, False)


@register("agg08_histogram", "AGG-08", L.with_ctes(f"""
SELECT s.bin, {sql_r('lo + (s.bin - 1) * (hi - lo) / 10')} AS lower, {sql_r('lo + s.bin * (hi - lo) / 10')} AS upper,
       coalesce(c.n, 0) AS count
FROM (SELECT unnest(range(1, 11)) AS bin) s CROSS JOIN rng
LEFT JOIN (SELECT least(10, greatest(1, CAST(floor((co2e_kg - lo) / (hi - lo) * 10) AS INTEGER) + 1)) AS bin,
                  count(*) AS n FROM rc, rng GROUP BY 1) c USING (bin)""",
    rc=RECORDS_CO2E_SQL, rng="SELECT min(co2e_kg) AS lo, max(co2e_kg) AS hi FROM rc"))
def agg08(spark, d):
    h = MO.histogram(records_co2e(spark, d), "co2e_kg", 10)
    return h.select("bin", r("lower").alias("lower"), r("upper").alias("upper"), "count")


COMBINED_SQL = """
SELECT coalesce(e.facility_id, w.facility_id, m.facility_id) AS facility_id,
       coalesce(e.bucket, w.bucket, m.bucket) AS bucket, e.energy_kwh, w.water_m3, m.co2_kg, m.anomaly_score
FROM (SELECT facility_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, sum(kwh) AS energy_kwh FROM eu GROUP BY 1, 2) e
FULL JOIN (SELECT facility_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, sum(cubic_meters) AS water_m3
           FROM wu GROUP BY 1, 2) w ON e.facility_id = w.facility_id AND e.bucket = w.bucket
FULL JOIN (SELECT facility_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, sum(co2_kg) AS co2_kg,
                  avg(anomaly_score) AS anomaly_score FROM em GROUP BY 1, 2) m
  ON m.facility_id = coalesce(e.facility_id, w.facility_id) AND m.bucket = coalesce(e.bucket, w.bucket)"""


@register("join04_combined_metrics", "JOIN-04", L.with_ctes(f"""
SELECT facility_id, bucket, {sql_r('energy_kwh')} AS energy_kwh, {sql_r('water_m3')} AS water_m3,
       {sql_r('co2_kg')} AS co2_kg, {sql_r('anomaly_score')} AS anomaly_score FROM cm""",
    eu=L.ENERGY_USAGE_SQL, wu=L.WATER_USAGE_SQL, em=L.EMISSION_METRICS_SQL, cm=COMBINED_SQL))
def join04(spark, d):
    cm = combined_metrics(L.energy_usage(spark, d), L.water_usage(spark, d), L.emission_metrics(spark, d))
    return cm.select("facility_id", "bucket", *[r(c).alias(c) for c in ("energy_kwh", "water_m3", "co2_kg",
                                                                        "anomaly_score")])


@register("agg06_esg_daily_one_facility", "AGG-06", L.with_ctes(f"""
SELECT bucket, {sql_r('sum(energy_kwh)')} AS energy, {sql_r('sum(water_m3)')} AS water, {sql_r('sum(co2_kg)')} AS emissions,
       {sql_r('avg(anomaly_score)')} AS anomaly
FROM cm GROUP BY bucket ORDER BY bucket""",
    eu=L.ENERGY_USAGE_SQL + " AND user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'",
    wu=L.WATER_USAGE_SQL + " AND user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'",
    em=L.EMISSION_METRICS_SQL + " WHERE user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'",
    cm=COMBINED_SQL))
def agg06(spark, d):
    out = RP.esg_daily(L.energy_usage(spark, d), L.water_usage(spark, d), L.emission_metrics(spark, d), 7,
                       "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    return out.select("bucket", *[r(c).alias(c) for c in ("energy", "water", "emissions", "anomaly")])


def _period_sql(days):
    rng = f"BETWEEN (SELECT max(ts) FROM em) - INTERVAL {days} DAY AND (SELECT max(ts) FROM em)"
    return L.with_ctes(f"""
SELECT {sql_r(f'(SELECT sum(kwh) FROM eu WHERE ts {rng})')} AS total_energy,
       {sql_r(f'(SELECT sum(cubic_meters) FROM wu WHERE ts {rng})')} AS total_water,
       {sql_r(f'(SELECT sum(co2_kg) FROM em WHERE ts {rng})')} AS total_emissions,
       {sql_r(f'(SELECT avg(anomaly_score) FROM em WHERE ts {rng})')} AS avg_anomaly""",
        eu=L.ENERGY_USAGE_SQL, wu=L.WATER_USAGE_SQL, em=L.EMISSION_METRICS_SQL)


def _period(spark, d, period):
    out = RP.esg_period_totals(L.energy_usage(spark, d), L.water_usage(spark, d), L.emission_metrics(spark, d), period)
    return out.select(*[r(c).alias(c) for c in ("total_energy", "total_water", "total_emissions", "avg_anomaly")])


@register("agg07_period_totals_week", "AGG-07", _period_sql(7))
def agg07w(spark, d):
    return _period(spark, d, "week")


@register("agg07_period_totals_month", "AGG-07", _period_sql(30))
def agg07m(spark, d):
    return _period(spark, d, "month")


@register("agg19_nightly_rollup", "AGG-19", L.with_ctes(f"""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, facility_id, {sql_r('sum(co2_kg)')} AS total_co2,
       {sql_r('avg(anomaly_score)')} AS avg_anomaly, CAST(ts AS DATE) AS day
FROM em WHERE ts > (SELECT max(ts) FROM em) - INTERVAL 30 DAY
GROUP BY 1, 2, 5""", em=L.EMISSION_METRICS_SQL))
def agg19(spark, d):
    from verdigris.operators.tables import scratch_path
    path = scratch_path(spark, "daily_rollup")
    RP.nightly_rollup(L.emission_metrics(spark, d), path)
    back = spark.read.parquet(path)
    return back.select("bucket", "facility_id", r("total_co2").alias("total_co2"),
                       r("avg_anomaly").alias("avg_anomaly"), "day")


NIGHTS_SQL = L.with_ctes(f"""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, user_id AS facility_id, {sql_r('sum(value)')} AS total_co2,
       {sql_r("avg(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100)")} AS avg_anomaly, count(*) AS n,
       min(value) AS value_min, max(value) AS value_max
FROM events GROUP BY 1, 2""")


def _six_nights(spark, d, compacted=()):
    """Six nights, each at noon: rows come with the night after their time,
    every fortieth of them two nights late, and one night's rows come twice
    (a retry).  Each night rolls up the days that its rows touch; after the
    nights ``compacted`` the arrivals are compacted, and one is retried again."""
    from verdigris.operators import rollups as RU
    from verdigris.operators.tables import scratch_path
    e, root = L.table(spark, d, "events"), scratch_path(spark, "rollup-nights")
    low, high = (x.date().toordinal() for x in e.agg(F.min("ts"), F.max("ts")).first())
    step = max(1, -(-(high - low + 1) // 6))
    noon = F.datediff(F.timestamp_add("HOUR", F.lit(12), F.col("ts")), F.date_from_unix_date(F.lit(low - 719163)))
    late = F.when(F.col("event_id") % 40 == 0, 2).otherwise(0)
    night = F.least(F.lit(5), F.greatest(F.lit(0), F.floor((noon - 1) / step)) + late).cast("int")
    (e.select("ts", F.col("user_id").alias("facility_id"), F.col("value").alias("co2_kg"),
              (F.get_json_object("props", "$.k").cast("double") / 100).alias("anomaly_score"), night.alias("night"))
     .write.partitionBy("night").parquet(f"{root}/landed"))
    for n in range(6):
        rows = spark.read.parquet(f"{root}/landed").where(F.col("night") == n)
        for _ in range(2 if n == 3 else 1):
            RU.record_arrivals(rows, f"{root}/table", f"night-{n}")
        RU.roll_up_changes(spark, f"{root}/table", f"night-{n}")
        if n in compacted:
            RU.compact(spark, f"{root}/table")
            RU.record_arrivals(rows, f"{root}/table", f"night-{n}")
    return RU.rolled_up(spark, f"{root}/table").select(
        "bucket", "facility_id", r("total_co2").alias("total_co2"), r("avg_anomaly").alias("avg_anomaly"), "n", "value_min", "value_max")


@register("agg19_incremental_rollup", "AGG-19", NIGHTS_SQL)
def agg19_incremental(spark, d):
    return _six_nights(spark, d)


@register("agg19_compacted_rollup", "AGG-19", NIGHTS_SQL)
def agg19_compacted(spark, d):
    return _six_nights(spark, d, (1, 3))


@register("join03_record_owner", "JOIN-03", L.with_ctes("""
SELECT record_id, o_custkey AS created_by, u.name AS owner_name, u.role AS owner_role
FROM rc LEFT JOIN orders ON order_key = o_orderkey LEFT JOIN us u ON u.user_id = o_custkey""",
    rc=L.EMISSION_RECORDS_SQL, us=L.USERS_SQL))
def join03(spark, d):
    out = with_owner(L.emission_records(spark, d), L.record_owners(spark, d), L.users(spark, d))
    return out.select("record_id", "created_by", "owner_name", "owner_role")


@register("join03_usage_facility", "JOIN-03", L.with_ctes("""
SELECT e.ts, e.facility_id, f.name, f.industry_type FROM eu e JOIN fac f USING (facility_id)""",
    eu=L.ENERGY_USAGE_SQL, fac=L.FACILITIES_SQL))
def join03b(spark, d):
    out = with_facility(L.energy_usage(spark, d), L.facilities(spark, d))
    return out.select("ts", "facility_id", "name", "industry_type")
