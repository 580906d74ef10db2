"""Registered checks: sequence features and fitted scalers (WIN-02..12,
ML-01..04, ML-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import features as FE
from verdigris.plans import logical as L
from verdigris.plans.catalog import register
from verdigris.plans.rounding import r, sql_r

W_EU = "PARTITION BY facility_id ORDER BY ts"


@register("win02_lag_features", "WIN-02", L.with_ctes(f"""
SELECT ts, facility_id, {', '.join(f'lag(kwh, {k}) OVER ({W_EU}) AS kwh_lag_{k}' for k in (1, 2, 3, 24, 168))}
FROM eu""", eu=L.ENERGY_USAGE_SQL))
def win02(spark, d):
    out = FE.lag_features(L.energy_usage(spark, d), {"kwh": [1, 2, 3, 24, 168]})
    return out.select("ts", "facility_id", *[f"kwh_lag_{k}" for k in (1, 2, 3, 24, 168)])


def _roll_sql():
    cols = []
    for n in (6, 24, 168):
        w = f"({W_EU} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"{sql_r(f'CASE WHEN count(kwh) OVER {w} = {n} THEN avg(kwh) OVER {w} END')} AS kwh_roll_mean_{n}")
    for n in (24, 168):
        w = f"({W_EU} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"{sql_r(f'CASE WHEN count(kwh) OVER {w} = {n} THEN stddev_samp(kwh) OVER {w} END')} AS kwh_roll_std_{n}")
    return L.with_ctes(f"SELECT ts, facility_id, {', '.join(cols)} FROM eu", eu=L.ENERGY_USAGE_SQL)


@register("win03_rolling_features", "WIN-03", _roll_sql())
def win03(spark, d):
    out = FE.rolling_features(L.energy_usage(spark, d), "kwh")
    return out.select("ts", "facility_id", *[r(c).alias(c) for c in out.columns if "_roll_" in c])


@register("win04_05_pulse_flow", "WIN-04", L.with_ctes(f"""
SELECT reading_id, {sql_r("0.00225 / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0, 0) * 60")} AS flow_lpm,
       {sql_r("count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 0.00225")} AS total_litres
FROM sf WHERE kind = 'click'
WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id)""", sf=L.SENSOR_FEED_SQL))
def win04(spark, d):
    p = L.sensor_feed(spark, d).filter(F.col("kind") == "click")
    out = FE.pulse_flow(p, key="sensor_id", tiebreak="reading_id")
    return out.select("reading_id", r("flow_lpm").alias("flow_lpm"), r("total_litres").alias("total_litres"))


@register("win08_time_linear_interpolation", "WIN-08", L.with_ctes(f"""
SELECT reading_id, {sql_r('''CASE WHEN value IS NOT NULL THEN value
  WHEN pv IS NOT NULL AND nv IS NOT NULL THEN
    CASE WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((epoch_us(ts) - pt) / (nt - pt)) END END''')} AS value
FROM (SELECT *,
   last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
   last_value(CASE WHEN value IS NOT NULL THEN CAST(epoch_us(ts) AS DOUBLE) END IGNORE NULLS)
       OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
   first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
   first_value(CASE WHEN value IS NOT NULL THEN CAST(epoch_us(ts) AS DOUBLE) END IGNORE NULLS)
       OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt
 FROM sf WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id))""", sf=L.SENSOR_FEED_SQL))
def win08(spark, d):
    out = FE.interpolate_linear(L.sensor_feed(spark, d), "value", key="sensor_id", tiebreak="reading_id")
    return out.select("reading_id", r("value").alias("value"))


def _windows_sql(window, horizon, drop_last=False):
    extra = f" AND i < n - {window} - {horizon} + 1" if drop_last else ""
    return L.with_ctes(f"""
SELECT facility_id, window_start, x_co2, y FROM (
  SELECT facility_id, ts AS window_start,
         list(co2_kg) OVER (w ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS x_co2,
         list(co2_kg) OVER (w ROWS BETWEEN {window} FOLLOWING AND {window + horizon - 1} FOLLOWING) AS y,
         row_number() OVER w AS i, count(*) OVER (PARTITION BY facility_id) AS n
  FROM em WINDOW w AS (PARTITION BY facility_id ORDER BY ts))
WHERE len(x_co2) = {window} AND len(y) = {horizon}{extra}""", em=L.EMISSION_METRICS_SQL)


def _windows(spark, d, window, horizon, drop_last=False):
    out = FE.training_windows(L.emission_metrics(spark, d), ["co2_kg", "anomaly_score"], "co2_kg",
                              window, horizon, drop_last=drop_last)
    return out.select("facility_id", "window_start", F.transform("x", lambda e: e["co2_kg"]).alias("x_co2"), "y")


@register("win09_training_windows", "WIN-09", _windows_sql(24, 6))
def win09(spark, d):
    return _windows(spark, d, 24, 6)


@register("win10_windows_drop_last", "WIN-10", _windows_sql(24, 1, drop_last=True))
def win10(spark, d):
    return _windows(spark, d, 24, 1, drop_last=True)


@register("win11_multi_horizon", "WIN-11", L.with_ctes("""
SELECT facility_id, ts AS window_start, lead(co2_kg, 24) OVER w AS y_h1, lead(co2_kg, 29) OVER w AS y_h6,
       lead(co2_kg, 47) OVER w AS y_h24
FROM em WINDOW w AS (PARTITION BY facility_id ORDER BY ts)
QUALIFY lead(co2_kg, 47) OVER w IS NOT NULL""", em=L.EMISSION_METRICS_SQL))
def win11(spark, d):
    return FE.multi_horizon_targets(L.emission_metrics(spark, d), "co2_kg", 24, (1, 6, 24))


@register("win12_chronological_split", "WIN-12", L.with_ctes("""
SELECT ts, facility_id, i < s + 24 AS in_train, i >= s AS in_test FROM (
  SELECT ts, facility_id, row_number() OVER (PARTITION BY facility_id ORDER BY ts) - 1 AS i,
         floor((count(*) OVER (PARTITION BY facility_id) - 24 - 1 + 1) * (1 - 0.2)) AS s
  FROM em)""", em=L.EMISSION_METRICS_SQL))
def win12(spark, d):
    out = FE.chronological_split(L.emission_metrics(spark, d), 24, 0.2)
    return out.select("ts", "facility_id", "in_train", "in_test")


CROWDED_SQL = """
SELECT event_id, user_id % 2 AS facility_id, value AS kwh,
       CASE WHEN event_id % 10 = 0 THEN ts
            ELSE TIMESTAMP '2024-01-10 07:00:00' + (event_id * 7919 % 3600) * INTERVAL 1 SECOND END AS ts
FROM events"""


def crowded(spark, d):
    """Two series with nine tenths of their rows in one hour."""
    e = L.table(spark, d, "events")
    at = F.timestamp_add("SECOND", (F.col("event_id") * 7919 % 3600).cast("int"), F.lit("2024-01-10 07:00:00").cast("timestamp_ntz"))
    return e.select("event_id", (F.col("user_id") % 2).alias("facility_id"), F.col("value").alias("kwh"),
                    F.when(F.col("event_id") % 10 == 0, F.col("ts").cast("timestamp_ntz")).otherwise(at).alias("ts"))


@register("win02_03_crowded_hour", "WIN-02", L.with_ctes(f"""
SELECT event_id, lag(kwh, 1) OVER w AS kwh_lag_1, lag(kwh, 24) OVER w AS kwh_lag_24,
       {sql_r("CASE WHEN count(kwh) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24 THEN avg(kwh) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END")} AS kwh_roll_mean_24,
       row_number() OVER w - 1 AS position
FROM c WINDOW w AS (PARTITION BY facility_id ORDER BY ts, event_id)""", c=CROWDED_SQL))
def win02_crowded(spark, d):
    from verdigris.operators import series as S
    c, bucket = crowded(spark, d), S.EqualDepth(2_000)
    lags = FE.lag_features(c, {"kwh": [1, 24]}, tiebreak="event_id", bucket=bucket)
    means = FE.rolling_features(c, "kwh", [24], [], tiebreak="event_id", bucket=bucket)
    places = S.positions(c, "facility_id", [F.col("ts"), F.col("event_id")], bucket)
    out = lags.join(means.select("event_id", r("kwh_roll_mean_24").alias("kwh_roll_mean_24")), "event_id")
    return (out.join(places.select("event_id", F.col("_i").alias("position")), "event_id")
            .select("event_id", "kwh_lag_1", "kwh_lag_24", "kwh_roll_mean_24", "position"))


@register("win08_09_crowded_hour", "WIN-09", L.with_ctes("""
SELECT facility_id, x, y FROM (
  SELECT facility_id, list(kwh) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS x,
         list(kwh) OVER (w ROWS BETWEEN 12 FOLLOWING AND 14 FOLLOWING) AS y
  FROM c WINDOW w AS (PARTITION BY facility_id ORDER BY ts, event_id))
WHERE len(x) = 12 AND len(y) = 3""", c=CROWDED_SQL))
def win09_crowded(spark, d):
    from verdigris.operators import series as S
    out = FE.training_windows(crowded(spark, d), ["kwh"], "kwh", 12, 3, tiebreak="event_id", bucket=S.EqualDepth(2_000))
    return out.select("facility_id", F.transform("x", lambda e: e["kwh"]).alias("x"), "y")


@register("ml01_iqr_capping", "ML-01", L.with_ctes(f"""
SELECT ts, facility_id,
  {sql_r('least(greatest(co2_kg, b.q1c - 1.5 * (b.q3c - b.q1c)), b.q3c + 1.5 * (b.q3c - b.q1c))')} AS co2_kg,
  {sql_r('least(greatest(anomaly_score, b.q1a - 1.5 * (b.q3a - b.q1a)), b.q3a + 1.5 * (b.q3a - b.q1a))')} AS anomaly_score
FROM em, (SELECT quantile_cont(co2_kg, 0.25) AS q1c, quantile_cont(co2_kg, 0.75) AS q3c,
                 quantile_cont(anomaly_score, 0.25) AS q1a, quantile_cont(anomaly_score, 0.75) AS q3a FROM em) b""",
    em=L.EMISSION_METRICS_SQL))
def ml01(spark, d):
    em = L.emission_metrics(spark, d)
    cols = ["co2_kg", "anomaly_score"]
    out = FE.apply_iqr_caps(em, FE.fit_iqr_caps(em, cols), cols)
    return out.select("ts", "facility_id", *[r(c).alias(c) for c in cols])


@register("ml02_median_impute_robust_scale", "ML-02", L.with_ctes(f"""
SELECT reading_id, {sql_r('(coalesce(value, m.med) - q.m2) / CASE WHEN q.q3 - q.q1 = 0 THEN 1.0 ELSE q.q3 - q.q1 END')} AS value
FROM sf, (SELECT median(value) AS med FROM sf) m,
     (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS m2, quantile_cont(v, 0.75) AS q3
      FROM (SELECT coalesce(value, (SELECT median(value) FROM sf)) AS v FROM sf)) q""", sf=L.SENSOR_FEED_SQL))
def ml02(spark, d):
    sf = L.sensor_feed(spark, d)
    out = FE.apply_robust(sf, FE.fit_robust(sf, ["value"]), ["value"])
    return out.select("reading_id", r("value").alias("value"))


@register("ml03_one_hot_unknown_zero", "ML-03", L.with_ctes("""
SELECT reading_id, """ + ", ".join(
    f"CASE WHEN coalesce(kind, 'missing') = '{k}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS kind_{k}"
    for k in ("click", "purchase", "signup", "view")) + " FROM sf", sf=L.SENSOR_FEED_SQL))
def ml03(spark, d):
    sf = L.sensor_feed(spark, d)
    vocab = FE.fit_categories(sf.filter(F.col("value").isNotNull()), ["kind"])
    return FE.one_hot(sf.select("reading_id", "kind"), vocab)


@register("ml03_many_categories", "ML-03", L.with_ctes("""
SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS customer_index FROM orders"""))
def ml03_many(spark, d):
    o = L.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"))
    return FE.category_index(o, FE.category_table(o, ["customer"]), ["customer"]).select("o_orderkey", "customer_index")


@register("ml04_standard_scaling", "ML-04", L.with_ctes(f"""
SELECT ts, facility_id,
  {sql_r('(co2_kg - s.mc) / CASE WHEN s.sc = 0 THEN 1.0 ELSE s.sc END')} AS co2_kg,
  {sql_r('(anomaly_score - s.ma) / CASE WHEN s.sa = 0 THEN 1.0 ELSE s.sa END')} AS anomaly_score
FROM em, (SELECT avg(co2_kg) AS mc, stddev_pop(co2_kg) AS sc, avg(anomaly_score) AS ma,
                 stddev_pop(anomaly_score) AS sa FROM em) s""", em=L.EMISSION_METRICS_SQL))
def ml04(spark, d):
    em = L.emission_metrics(spark, d)
    cols = ["co2_kg", "anomaly_score"]
    out = FE.apply_standard(em, FE.fit_standard(em, cols), cols)
    return out.select("ts", "facility_id", *[r(c).alias(c) for c in cols])


@register("ml06_window_augmentation", "ML-06")
def ml06(spark, d):
    w = FE.training_windows(L.emission_metrics(spark, d), ["co2_kg"], "co2_kg", 24, 1)
    w = w.withColumn("x_values", F.transform("x", lambda e: e["co2_kg"]))
    out = FE.augment_windows(w, seed=7)
    return out.select("facility_id", "window_start", "x_values", "y")


@register("ml06_given_augmentation", "ML-06", L.with_ctes(f"""
SELECT facility_id, window_start, list_transform(x, lambda v: {sql_r('v * 1.05 + 0.5')}) AS x_values, y FROM (
  SELECT facility_id, ts AS window_start, list(co2_kg) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS x,
         list(co2_kg) OVER (w ROWS BETWEEN 12 FOLLOWING AND 12 FOLLOWING) AS y
  FROM em WINDOW w AS (PARTITION BY facility_id ORDER BY ts)) WHERE len(x) = 12 AND len(y) = 1""", em=L.EMISSION_METRICS_SQL))
def ml06_given(spark, d):
    """Augmentation whose coins are certain: every window scaled by 1.05 and
    shifted by 0.5, none with noise."""
    w = FE.training_windows(L.emission_metrics(spark, d), ["co2_kg"], "co2_kg", 12, 1)
    w = w.withColumn("x_values", F.transform("x", lambda e: e["co2_kg"]))
    out = FE.augment_windows(w, p_noise=0.0, p_scale=1.0, scale_lo=1.05, scale_hi=1.05, shift=0.5)
    return out.select("facility_id", "window_start", F.transform("x_values", lambda v: r(v)).alias("x_values"), "y")
