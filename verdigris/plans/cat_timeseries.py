"""Registered checks: filters, roll-ups, gap fill, ordering, latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import carbon as CO
from verdigris.operators import timeseries as T
from verdigris.plans import logical as L
from verdigris.plans.catalog import register

from verdigris.plans.rounding import R4, r, sql_r  # noqa: F401


RECORDS_CO2E_SQL = f"""
SELECT *, CASE WHEN co2e_kg IS NULL OR energy_kwh IS NULL THEN NULL
               WHEN energy_kwh = 0 THEN 0.0 ELSE co2e_kg / energy_kwh END AS carbon_intensity
FROM (SELECT *, co2_kg + coalesce(ch4_g, 0) / 1000 * 28.0 + coalesce(n2o_g, 0) / 1000 * 265.0 AS co2e_kg
      FROM ({L.EMISSION_RECORDS_SQL}))"""


def records_co2e(spark, d):
    return CO.with_co2e(L.emission_records(spark, d))


# ---------------------------------------------------------------- AGG-01
@register("agg01_daily_emissions", "AGG-01", L.with_ctes("""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, facility_id,
       (floor((sum(co2_kg)) * 10000 + 0.5001) / 10000) AS total_co2, (floor((avg(anomaly_score)) * 10000 + 0.5001) / 10000) AS avg_anomaly
FROM em WHERE ts > (SELECT max(ts) FROM em) - INTERVAL 30 DAY
GROUP BY 1, 2""", em=L.EMISSION_METRICS_SQL))
def agg01(spark, d):
    out = T.daily_emissions(L.emission_metrics(spark, d), days=30)
    return out.select("bucket", "facility_id", r("total_co2").alias("total_co2"),
                      r("avg_anomaly").alias("avg_anomaly"))


@register("agg01_weekly_emissions", "AGG-01", L.with_ctes("""
SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS bucket, facility_id,
       (floor((sum(co2_kg)) * 10000 + 0.5001) / 10000) AS total_co2, (floor((avg(anomaly_score)) * 10000 + 0.5001) / 10000) AS avg_anomaly
FROM em WHERE ts > (SELECT max(ts) FROM em) - INTERVAL 30 DAY
GROUP BY 1, 2""", em=L.EMISSION_METRICS_SQL))
def agg01w(spark, d):
    out = T.daily_emissions(L.emission_metrics(spark, d), days=30, width="1 week")
    return out.select("bucket", "facility_id", r("total_co2").alias("total_co2"),
                      r("avg_anomaly").alias("avg_anomaly"))


# ---------------------------------------------------------------- filters
@register("flt02_trailing_7d", "FLT-02", L.with_ctes("""
SELECT ts, facility_id, co2_kg FROM em
WHERE ts > (SELECT max(ts) FROM em) - INTERVAL 7 DAY""", em=L.EMISSION_METRICS_SQL))
def flt02(spark, d):
    return T.trailing(L.emission_metrics(spark, d), 7).select("ts", "facility_id", "co2_kg")


@register("flt03_trailing_inclusive", "FLT-03", L.with_ctes("""
SELECT record_id, ts, (floor((co2e_kg) * 10000 + 0.5001) / 10000) AS co2e_kg FROM rc
WHERE ts BETWEEN (SELECT max(ts) FROM rc) - INTERVAL 30 DAY AND (SELECT max(ts) FROM rc)""",
    rc=RECORDS_CO2E_SQL))
def flt03(spark, d):
    return (T.trailing(records_co2e(spark, d), 30, inclusive=True)
             .select("record_id", "ts", r("co2e_kg").alias("co2e_kg")))


@register("flt01_optional_filters", "FLT-01", L.with_ctes("""
SELECT record_id, ts, source_type, (floor((co2e_kg) * 10000 + 0.5001) / 10000) AS co2e_kg FROM rc
WHERE ts BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'
  AND source_type = 'NO' AND co2e_kg >= 50""", rc=RECORDS_CO2E_SQL))
def flt01(spark, d):
    out = T.filter_emissions(records_co2e(spark, d), start="1997-01-01 00:00:00",
                             end="1997-12-31 00:00:00", source_type="NO", min_co2e=50)
    return out.select("record_id", "ts", "source_type", r("co2e_kg").alias("co2e_kg"))


@register("flt01_min_zero_unset", "FLT-01", L.with_ctes("""
SELECT record_id, ts FROM rc WHERE ts >= TIMESTAMP '2001-06-01 00:00:00'""", rc=RECORDS_CO2E_SQL))
def flt01b(spark, d):
    out = T.filter_emissions(records_co2e(spark, d), start="2001-06-01 00:00:00", min_co2e=0)
    return out.select("record_id", "ts")


@register("flt04_facility_range", "FLT-04", L.with_ctes("""
SELECT ts, facility_id, co2_kg FROM em
WHERE facility_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
    em=L.EMISSION_METRICS_SQL))
def flt04(spark, d):
    return (T.facility_range(L.emission_metrics(spark, d), 7, "2024-01-05 00:00:00", "2024-01-20 00:00:00")
             .select("ts", "facility_id", "co2_kg"))


@register("flt05_chart_24h", "FLT-05", L.with_ctes("""
SELECT p AS preset, ts, facility_id, kwh FROM eu, (VALUES ('24h', 1), ('7d', 7), ('30d', 30)) v(p, days)
WHERE ts > (SELECT max(ts) FROM eu) - days * INTERVAL 1 DAY""",
    eu=L.ENERGY_USAGE_SQL))
def flt05(spark, d):
    out = None
    for preset in T.CHART_RANGES:
        rows = T.chart_range(L.energy_usage(spark, d), preset).select(F.lit(preset).alias("preset"), "ts", "facility_id", "kwh")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- AGG-02/03/04/11
@register("agg02_gapfilled_daily", "AGG-02", L.with_ctes("""
SELECT s.bucket, (floor((a.avg_co2e) * 10000 + 0.5001) / 10000) AS avg_co2e, (floor((a.total_energy) * 10000 + 0.5001) / 10000) AS total_energy,
       (floor((a.total_water) * 10000 + 0.5001) / 10000) AS total_water
FROM (SELECT CAST(generate_series AS TIMESTAMP) AS bucket FROM generate_series(
        date_trunc('day', (SELECT max(ts) FROM rc) - INTERVAL 90 DAY),
        date_trunc('day', (SELECT max(ts) FROM rc)), INTERVAL 1 DAY)) s
LEFT JOIN (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, avg(co2e_kg) AS avg_co2e,
                  sum(energy_kwh) AS total_energy, sum(water_l) AS total_water
           FROM rc WHERE ts BETWEEN (SELECT max(ts) FROM rc) - INTERVAL 90 DAY AND (SELECT max(ts) FROM rc)
           GROUP BY 1) a ON s.bucket = a.bucket""", rc=RECORDS_CO2E_SQL))
def agg02(spark, d):
    out = T.gapfilled_daily_stats(records_co2e(spark, d), days=90)
    return out.select("bucket", r("avg_co2e").alias("avg_co2e"), r("total_energy").alias("total_energy"),
                      r("total_water").alias("total_water"))


@register("agg03_hourly_energy", "AGG-03", L.with_ctes("""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, (floor((sum(kwh)) * 10000 + 0.5001) / 10000) AS total, count(*) AS n
FROM eu GROUP BY 1""", eu=L.ENERGY_USAGE_SQL))
def agg03(spark, d):
    out = T.bucket_totals(L.energy_usage(spark, d), "kwh", "1 hour")
    return out.select("bucket", r("total").alias("total"), "n")


@register("agg04_historical_daily_per_facility", "AGG-04", L.with_ctes("""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, facility_id, (floor((sum(cubic_meters)) * 10000 + 0.5001) / 10000) AS total,
       count(*) AS n
FROM wu WHERE ts BETWEEN (SELECT max(ts) FROM wu) - INTERVAL 7 DAY AND (SELECT max(ts) FROM wu)
GROUP BY 1, 2""", wu=L.WATER_USAGE_SQL))
def agg04(spark, d):
    w = T.trailing(L.water_usage(spark, d), 7, inclusive=True)
    out = T.bucket_totals(w, "cubic_meters", "daily", keys=("facility_id",))
    return out.select("bucket", "facility_id", r("total").alias("total"), "n")


@register("agg11_period_stats", "AGG-11", L.with_ctes("""
SELECT (floor((sum(co2e_kg)) * 10000 + 0.5001) / 10000) AS total_co2e, (floor((avg(carbon_intensity)) * 10000 + 0.5001) / 10000) AS avg_intensity,
       (floor((sum(energy_kwh)) * 10000 + 0.5001) / 10000) AS total_energy, (floor((sum(water_l)) * 10000 + 0.5001) / 10000) AS total_water,
       arg_max(ts, (co2e_kg, ts)) AS peak_ts
FROM rc""", rc=RECORDS_CO2E_SQL))
def agg11(spark, d):
    out = T.period_stats(records_co2e(spark, d))
    return out.select(*[r(c).alias(c) for c in ("total_co2e", "avg_intensity", "total_energy", "total_water")],
                      "peak_ts")


# ---------------------------------------------------------------- SRT / paging
@register("srt01_page", "SRT-01", L.with_ctes("""
SELECT record_id, ts, (floor((co2e_kg) * 10000 + 0.5001) / 10000) AS co2e_kg FROM rc
ORDER BY ts DESC, record_id ASC LIMIT 50 OFFSET 100""", rc=RECORDS_CO2E_SQL))
def srt01(spark, d):
    return T.page(records_co2e(spark, d), 3, 50).select("record_id", "ts", r("co2e_kg").alias("co2e_kg"))


@register("agg12_page_summary", "AGG-12", L.with_ctes("""
SELECT count(*) AS count, round(coalesce(sum(co2e_kg), 0), 2) AS total_co2e FROM (
  SELECT * FROM rc ORDER BY ts DESC, record_id ASC LIMIT 50 OFFSET 100)""",
    rc=RECORDS_CO2E_SQL))
def agg12(spark, d):
    return T.page_summary(T.page(records_co2e(spark, d), 3, 50))


@register("srt02_newest_energy", "SRT-02", L.with_ctes("""
SELECT ts, facility_id, kwh FROM eu ORDER BY ts DESC, facility_id, kwh LIMIT 1""", eu=L.ENERGY_USAGE_SQL))
def srt02(spark, d):
    return T.newest(L.energy_usage(spark, d), tiebreak=("facility_id", "kwh")).select("ts", "facility_id", "kwh")


@register("srt03_daily_ordered_desc", "SRT-03", L.with_ctes("""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, (floor((sum(co2_kg)) * 10000 + 0.5001) / 10000) AS total_co2
FROM em GROUP BY 1 ORDER BY 1 DESC""", em=L.EMISSION_METRICS_SQL))
def srt03(spark, d):
    out = T.bucket_totals(L.emission_metrics(spark, d), "co2_kg", "1 day", alias="total_co2")
    return out.orderBy(F.desc("bucket")).select("bucket", r("total_co2").alias("total_co2"))


# ---------------------------------------------------------------- WIN-06/07, AGG-20, JOIN-02
@register("win06_last30_per_facility", "WIN-06", L.with_ctes("""
SELECT ts, facility_id, kwh FROM (
  SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY ts DESC, kwh) AS rn FROM eu) WHERE rn <= 30""",
    eu=L.ENERGY_USAGE_SQL))
def win06(spark, d):
    return T.last_n_per_key(L.energy_usage(spark, d), "facility_id", 30, tiebreak="kwh").select("ts", "facility_id", "kwh")


@register("win07_current_per_facility", "WIN-07", L.with_ctes("""
SELECT coalesce(e.facility_id, w.facility_id, m.facility_id) AS facility_id,
       e.kwh AS last_energy, w.cubic_meters AS last_water, m.co2_kg AS last_co2,
       greatest(e.ts, w.ts, m.ts) AS last_reading
FROM (SELECT facility_id, arg_max(kwh, ts) AS kwh, max(ts) AS ts FROM eu GROUP BY 1) e
FULL JOIN (SELECT facility_id, arg_max(cubic_meters, ts) AS cubic_meters, max(ts) AS ts FROM wu GROUP BY 1) w
  USING (facility_id)
FULL JOIN (SELECT facility_id, arg_max(co2_kg, ts) AS co2_kg, max(ts) AS ts FROM em GROUP BY 1) m
  ON m.facility_id = coalesce(e.facility_id, w.facility_id)""",
    eu=L.ENERGY_USAGE_SQL, wu=L.WATER_USAGE_SQL, em=L.EMISSION_METRICS_SQL))
def win07(spark, d):
    from verdigris.operators.joins import current_readings
    return current_readings(L.energy_usage(spark, d), L.water_usage(spark, d), L.emission_metrics(spark, d))


@register("agg20_first_per_sensor_minute", "AGG-20", L.with_ctes("""
SELECT reading_id, ts, sensor_id FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id, date_trunc('minute', ts) ORDER BY ts, reading_id) AS rn
  FROM sf) WHERE rn = 1""", sf=L.SENSOR_FEED_SQL))
def agg20(spark, d):
    return (T.first_per_interval(L.sensor_feed(spark, d), "sensor_id", "minute", tiebreak="reading_id")
             .select("reading_id", "ts", "sensor_id"))


@register("agg20_first_per_sensor_hour", "AGG-20", L.with_ctes("""
SELECT reading_id, ts, sensor_id FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id, date_trunc('hour', ts) ORDER BY ts, reading_id) AS rn
  FROM sf) WHERE rn = 1""", sf=L.SENSOR_FEED_SQL))
def agg20h(spark, d):
    return (T.first_per_interval(L.sensor_feed(spark, d), "sensor_id", "hour", tiebreak="reading_id")
             .select("reading_id", "ts", "sensor_id"))


@register("join02_latest_per_facility", "JOIN-02", L.with_ctes("""
SELECT e.facility_id, e.kwh AS last_energy, w.cubic_meters AS last_water,
       greatest(e.ts, w.ts) AS last_reading
FROM (SELECT facility_id, arg_max(kwh, ts) AS kwh, max(ts) AS ts FROM eu GROUP BY 1) e
JOIN (SELECT facility_id, arg_max(cubic_meters, ts) AS cubic_meters, max(ts) AS ts FROM wu GROUP BY 1) w
USING (facility_id)""", eu=L.ENERGY_USAGE_SQL, wu=L.WATER_USAGE_SQL))
def join02b(spark, d):
    from verdigris.operators.joins import latest_energy_water
    return latest_energy_water(L.energy_usage(spark, d), L.water_usage(spark, d), per_facility=True)


# ---------------------------------------------------------------- anomaly
def stats_sql(rows: str) -> str:
    """Median and median absolute deviation of each facility, from the
    definition: the mean of the one or two middle values of the ordered rows,
    then the same of the distances from it."""
    return f"""
SELECT facility_id, any_value(median_co2) AS median_co2, avg(off) AS mad_co2 FROM (
  SELECT facility_id, median_co2, off, row_number() OVER (PARTITION BY facility_id ORDER BY off) AS place,
         count(*) OVER (PARTITION BY facility_id) AS size
  FROM (SELECT o.facility_id, c.median_co2, abs(o.co2_kg - c.median_co2) AS off FROM ({rows}) o JOIN (
          SELECT facility_id, avg(co2_kg) AS median_co2 FROM (
            SELECT facility_id, co2_kg, row_number() OVER (PARTITION BY facility_id ORDER BY co2_kg) AS place,
                   count(*) OVER (PARTITION BY facility_id) AS size FROM ({rows}))
          WHERE place IN ((size + 1) // 2, (size + 2) // 2) GROUP BY facility_id) c USING (facility_id)))
WHERE place IN ((size + 1) // 2, (size + 2) // 2) GROUP BY facility_id"""


STATS_SQL = stats_sql("SELECT * FROM em WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM em)")


@register("agg05_facility_median_mad", "AGG-05", L.with_ctes("""
SELECT facility_id, (floor((median_co2) * 10000 + 0.5001) / 10000) AS median_co2, (floor((mad_co2) * 10000 + 0.5001) / 10000) AS mad_co2 FROM stats""",
    em=L.EMISSION_METRICS_SQL, stats=STATS_SQL))
def agg05(spark, d):
    from verdigris.operators.anomaly import facility_stats
    s = facility_stats(L.emission_metrics(spark, d), days=7)
    return s.select("facility_id", r("median_co2").alias("median_co2"), r("mad_co2").alias("mad_co2"))


@register("win01_robust_anomalies", "WIN-01", L.with_ctes("""
SELECT ts, facility_id, co2_kg, (floor(score * 10000 + 0.5001) / 10000) AS z_score
FROM (SELECT em.*, CASE WHEN mad_co2 > 0 THEN abs(co2_kg - median_co2) / mad_co2 END AS score FROM stats JOIN em USING (facility_id))
WHERE score > 3 AND ts > (SELECT max(ts) - INTERVAL 1 DAY FROM em)""", em=L.EMISSION_METRICS_SQL, stats=STATS_SQL))
def win01(spark, d):
    from verdigris.operators.anomaly import robust_anomalies
    out = robust_anomalies(L.emission_metrics(spark, d))
    return out.select("ts", "facility_id", "co2_kg", r("z_score").alias("z_score"))


@register("join01_scores_all_rows", "JOIN-01", L.with_ctes("""
SELECT e.ts, e.facility_id, (floor((abs(e.co2_kg - s.median_co2) / nullif(s.mad_co2, 0)) * 10000 + 0.5001) / 10000) AS z_score
FROM em e JOIN stats s USING (facility_id)""", em=L.EMISSION_METRICS_SQL, stats=STATS_SQL))
def join01(spark, d):
    from verdigris.operators.anomaly import anomaly_scores, facility_stats
    m = L.emission_metrics(spark, d)
    out = anomaly_scores(m, facility_stats(m, days=7))
    return out.select("ts", "facility_id", r("z_score").alias("z_score"))


@register("flt09_iqr_per_facility", "FLT-09", L.with_ctes("""
SELECT e.ts, e.facility_id, e.co2_kg FROM em e JOIN (
  SELECT facility_id, quantile_cont(co2_kg, 0.25) AS q1, quantile_cont(co2_kg, 0.75) AS q3 FROM em GROUP BY 1) b
USING (facility_id)
WHERE e.co2_kg BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)""", em=L.EMISSION_METRICS_SQL))
def flt09(spark, d):
    from verdigris.operators.anomaly import iqr_filter
    return iqr_filter(L.emission_metrics(spark, d), "co2_kg", ["facility_id"]).select("ts", "facility_id", "co2_kg")


@register("flt09_iqr_global", "FLT-09", L.with_ctes("""
SELECT e.record_id, e.water_l FROM rc e, (
  SELECT quantile_cont(water_l, 0.25) AS q1, quantile_cont(water_l, 0.75) AS q3 FROM rc) b
WHERE e.water_l BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)""", rc=RECORDS_CO2E_SQL))
def flt09g(spark, d):
    from verdigris.operators.anomaly import iqr_filter
    return iqr_filter(L.emission_records(spark, d), "water_l").select("record_id", "water_l")


@register("flt07_overload_alerts", "FLT-07", L.with_ctes("""
SELECT ts, facility_id, kwh AS power FROM eu WHERE kwh > 40.0""", eu=L.ENERGY_USAGE_SQL))
def flt07(spark, d):
    from verdigris.operators.anomaly import overload_alerts
    rd = L.energy_usage(spark, d).withColumnRenamed("kwh", "power")
    return overload_alerts(rd, 40.0).select("ts", "facility_id", "power")


@register("flt08_leak_alerts", "FLT-08", L.with_ctes("""
SELECT ts, facility_id, cubic_meters AS flow_rate FROM wu
WHERE NOT (source = 'purchase') AND cubic_meters > 0.1""", wu=L.WATER_USAGE_SQL))
def flt08(spark, d):
    from verdigris.operators.anomaly import leak_alerts
    rd = (L.water_usage(spark, d).withColumnRenamed("cubic_meters", "flow_rate")
          .withColumn("valve_open", F.col("source") == "purchase"))
    return leak_alerts(rd).select("ts", "facility_id", "flow_rate")


@register("agg02_gapfilled_daily_per_facility", "AGG-02", L.with_ctes("""
SELECT f.facility_id, s.bucket, (floor((a.avg_co2e) * 10000 + 0.5001) / 10000) AS avg_co2e,
       (floor((a.total_energy) * 10000 + 0.5001) / 10000) AS total_energy
FROM (SELECT DISTINCT facility_id FROM rc
      WHERE ts BETWEEN (SELECT max(ts) FROM rc) - INTERVAL 30 DAY AND (SELECT max(ts) FROM rc)) f
CROSS JOIN (SELECT CAST(generate_series AS TIMESTAMP) AS bucket FROM generate_series(
        date_trunc('day', (SELECT max(ts) FROM rc) - INTERVAL 30 DAY),
        date_trunc('day', (SELECT max(ts) FROM rc)), INTERVAL 1 DAY)) s
LEFT JOIN (SELECT facility_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, avg(co2e_kg) AS avg_co2e,
                  sum(energy_kwh) AS total_energy
           FROM rc WHERE ts BETWEEN (SELECT max(ts) FROM rc) - INTERVAL 30 DAY AND (SELECT max(ts) FROM rc)
           GROUP BY 1, 2) a ON a.facility_id = f.facility_id AND a.bucket = s.bucket""", rc=RECORDS_CO2E_SQL))
def agg02f(spark, d):
    out = T.gapfilled_daily_stats(records_co2e(spark, d), days=30, keys=("facility_id",))
    return out.select("facility_id", "bucket", r("avg_co2e").alias("avg_co2e"),
                      r("total_energy").alias("total_energy"))


# ---------------------------------------------------------------- chunked tables and added files
@register("flt02_trailing_monthly_chunks", "FLT-02", L.with_ctes("""
SELECT ts, facility_id, co2_kg FROM em WHERE ts > (SELECT max(ts) FROM em) - INTERVAL 7 DAY""", em=L.EMISSION_METRICS_SQL))
def flt02_monthly(spark, d):
    from verdigris.operators import tables as TB
    path = TB.scratch_path(spark, "monthly")
    TB.write_chunked(L.emission_metrics(spark, d), path, "1 month")
    return T.trailing(spark.read.parquet(path), 7).select("ts", "facility_id", "co2_kg")


@register("agg05_median_after_added_file", "AGG-05", L.with_ctes("""
SELECT 'before' AS phase, facility_id, (floor(median(co2_kg) * 10000 + 0.5001) / 10000) AS median_co2
FROM em WHERE day(ts) <= 15 GROUP BY 2
UNION ALL SELECT 'after', facility_id, (floor(median(co2_kg) * 10000 + 0.5001) / 10000) FROM em GROUP BY 2""",
    em=L.EMISSION_METRICS_SQL))
def agg05_added(spark, d):
    from verdigris.functions.quantiles import exact_median
    from verdigris.operators import tables as TB
    path, em = TB.scratch_path(spark, "grows"), L.emission_metrics(spark, d)
    out = []
    for phase, rows in (("before", em.filter(F.dayofmonth("ts") <= 15)), ("after", em.filter(F.dayofmonth("ts") > 15))):
        rows.write.mode("append").parquet(path)
        stats = exact_median(spark.read.parquet(path), ["facility_id"], "co2_kg", "median_co2")
        done = TB.scratch_path(spark, f"median-{phase}")
        stats.select(F.lit(phase).alias("phase"), "facility_id", r("median_co2").alias("median_co2")).write.parquet(done)
        out.append(spark.read.parquet(done))
    return out[0].unionByName(out[1])


@register("agg05_daily_sketches", "AGG-05", L.with_ctes("""
SELECT facility_id, (floor((median_co2) * 10000 + 0.5001) / 10000) AS median_co2, (floor((mad_co2) * 10000 + 0.5001) / 10000) AS mad_co2 FROM stats""",
    em=L.EMISSION_METRICS_SQL, stats=STATS_SQL))
def agg05_sketches(spark, d):
    """The week's statistics from stored sketches: all days but the newest
    were kept before, the newest is read and added, the week is merged."""
    s, _, _ = _sketched(spark, d)
    return s.select("facility_id", r("median_co2").alias("median_co2"), r("mad_co2").alias("mad_co2"))


def _sketched(spark, d):
    from verdigris.operators import daysketch as DS
    from verdigris.operators import tables as TB
    em, root = L.emission_metrics(spark, d), TB.scratch_path(spark, "day-sketches")
    now = em.agg(F.max("ts")).first()[0]
    for rows in (em.filter(F.to_date("ts") < F.lit(now.date())), em.filter(F.to_date("ts") == F.lit(now.date()))):
        DS.sketch_days(rows, root)
    return DS.trailing_stats(spark, root, em, now, 7), em, now


@register("win01_from_sketches", "WIN-01", L.with_ctes("""
SELECT ts, facility_id, co2_kg, (floor(score * 10000 + 0.5001) / 10000) AS z_score
FROM (SELECT em.*, CASE WHEN mad_co2 > 0 THEN abs(co2_kg - median_co2) / mad_co2 END AS score FROM stats JOIN em USING (facility_id))
WHERE score > 3 AND ts > (SELECT max(ts) - INTERVAL 1 DAY FROM em)""", em=L.EMISSION_METRICS_SQL, stats=STATS_SQL))
def win01_sketches(spark, d):
    from verdigris.operators.anomaly import robust_anomalies
    s, em, now = _sketched(spark, d)
    return robust_anomalies(em, now, stats=s).select("ts", "facility_id", "co2_kg", r("z_score").alias("z_score"))


@register("srt01_deep_page", "SRT-01", L.with_ctes("""
SELECT 10000 AS page_no, * FROM (SELECT record_id, ts, order_key FROM rc ORDER BY ts DESC, record_id LIMIT 5 OFFSET 49995)
UNION ALL SELECT 41, * FROM (SELECT record_id, ts, order_key FROM rc ORDER BY ts DESC, record_id LIMIT 1000 OFFSET 40000)""",
    rc=L.EMISSION_RECORDS_SQL))
def srt01_deep(spark, d):
    rc, out = L.emission_records(spark, d).select("record_id", "ts", "order_key"), []
    for page_no, size in ((10_000, 5), (41, 1000)):
        out.append(T.page(rc, page_no, size).select(F.lit(page_no).alias("page_no"), "record_id", "ts", "order_key"))
    return out[0].unionByName(out[1])
