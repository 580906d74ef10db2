"""Registered checks: forecasting (ML-05, ML-07..16, WIN-13, AGG-17).
Trained models have no SQL twin; those are rows-only checks, with
properties asserted in tests/."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.quantiles import stored
from verdigris.operators import features as FE
from verdigris.operators import forecast as FC
from verdigris.operators.carbon import with_interval
from verdigris.operators.tables import scratch_path
from verdigris.plans import logical as L
from verdigris.plans.catalog import register
from verdigris.plans.rounding import r, sql_r


def _features(spark, d):
    """Features of the metrics, stored: a model's passes share one computation."""
    feats, cols = FC.forecast_features(L.emission_metrics(spark, d), "co2_kg")
    return stored(feats.select("ts", "facility_id", "co2_kg", *cols), "features"), cols


@register("ml05_preprocessor_fit_transform", "ML-05")
def ml05(spark, d):
    em = L.emission_metrics(spark, d).join(
        L.sensor_feed(spark, d).select(F.col("ts"), F.col("sensor_id").alias("facility_id"), "kind"),
        ["ts", "facility_id"])
    pre = FC.TelemetryPreprocessor(numericCols=["co2_kg", "anomaly_score"], categoricalCols=["kind"])
    model = pre.fit(em)
    path = scratch_path(spark, "preprocessor")
    model.write().overwrite().save(path)
    back = FC.TelemetryPreprocessorModel.load(path)
    return back.transform(em)


@register("ml07_ml14_train_linear", "ML-07")
def ml07(spark, d):
    feats, cols = _features(spark, d)
    res = FC.train_forecaster(feats, cols, "co2_kg", "linear")
    return res["metrics"].withColumn("sigma", F.lit(res["sigma"]))


@register("ml08_gbt_early_stopping", "ML-08")
def ml08(spark, d):
    feats, cols = _features(spark, d)
    res = FC.train_forecaster(feats, cols, "co2_kg", "gbt", max_iter=20)
    return res["metrics"]


@register("ml09_grid_search", "ML-09")
def ml09(spark, d):
    feats, cols = _features(spark, d)
    tvs = FC.tune(feats, cols, "co2_kg", parallelism=2)
    return spark.createDataFrame([(float(m),) for m in tvs.validationMetrics], "rmse double")


@register("ml10_ml11_ml15_versioned_registry", "ML-10")
def ml10(spark, d):
    feats, cols = FC.forecast_features(L.emission_metrics(spark, d), "co2_kg")
    root, data_path = scratch_path(spark, "models"), scratch_path(spark, "scoring")
    feats.write.parquet(data_path)              # the table that is scored is also what the model is fitted on
    feats = spark.read.schema(feats.schema).parquet(data_path)
    res = FC.train_forecaster(feats, cols, "co2_kg", "linear")
    m = res["metrics"].first()
    FC.save_version(spark, res["model"], root, "v1", {"rmse": m["rmse"], "mae": m["mae"]})
    FC.promote(spark, root, None, {"version": "v1", "rmse": m["rmse"]})
    model = FC.load_version(spark, root, "production")
    return FC.score_parquet(spark, model, data_path).select("ts", "facility_id", "co2_kg", "prediction")


@register("ml12_win13_recursive_forecast", "ML-12")
def ml12(spark, d):
    em = L.emission_metrics(spark, d)
    daily = em.groupBy("facility_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.sum("co2_kg").alias("co2_kg"))
    daily = stored(daily, "daily")
    feats, cols = FC.forecast_features(daily, "co2_kg", lags=(1, 2, 3), means=())
    feats = stored(feats.select("ts", "facility_id", "co2_kg", *cols), "features")
    res = FC.train_forecaster(feats, ["co2_kg_lag_1", "co2_kg_lag_2", "co2_kg_lag_3"], "co2_kg", "linear")
    b, coefs = FC.linear_coefficients(res["model"])
    fc = FC.recursive_forecast(daily, "co2_kg", b, coefs, steps=7, step_interval="1 day")
    return with_interval(fc.withColumn("sigma", F.lit(res["sigma"])), pred="forecast")


@register("ml12_given_coefficients", "ML-12", L.with_ctes(f"""
SELECT facility_id, step, last + step * INTERVAL 1 DAY AS forecast_ts, {sql_r('f')} AS forecast FROM (
  SELECT *, 1 AS step, f1 AS f FROM s3 UNION ALL SELECT *, 2, f2 FROM s3 UNION ALL SELECT *, 3, f3 FROM s3)""",
    em=L.EMISSION_METRICS_SQL, daily="SELECT facility_id, date_trunc('day', ts) AS ts, sum(co2_kg) AS v FROM em GROUP BY 1, 2",
    lagged="""SELECT facility_id, max(ts) AS last, arg_max(v, ts) AS a, list(v ORDER BY ts DESC)[2] AS b2,
       list(v ORDER BY ts DESC)[3] AS c3, list(v ORDER BY ts)[1] AS oldest FROM daily GROUP BY 1""",
    s1="SELECT *, coalesce(b2, oldest) AS b, coalesce(c3, oldest) AS c FROM lagged",
    s1f="SELECT *, 1.5 + 0.5 * a + 0.3 * b + 0.1 * c AS f1 FROM s1",
    s2="SELECT *, 1.5 + 0.5 * f1 + 0.3 * a + 0.1 * b AS f2 FROM s1f",
    s3="SELECT *, 1.5 + 0.5 * f2 + 0.3 * f1 + 0.1 * a AS f3 FROM s2"))
def ml12_given(spark, d):
    em = L.emission_metrics(spark, d)
    daily = em.groupBy("facility_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("co2_kg").alias("co2_kg"))
    fc = FC.recursive_forecast(daily, "co2_kg", 1.5, [0.5, 0.3, 0.1], steps=3, step_interval="1 day")
    return fc.select("facility_id", "step", "forecast_ts", r("forecast").alias("forecast"))


@register("ml12_refreshed_features", "ML-12", L.with_ctes(f"""
SELECT facility_id, step, last + step * INTERVAL 6 HOUR AS forecast_ts, {sql_r('buf[1]')} AS forecast FROM steps WHERE step > 0""",
    em=L.EMISSION_METRICS_SQL, slots="SELECT facility_id, time_bucket(INTERVAL 6 HOUR, ts) AS ts, sum(co2_kg) AS v FROM em GROUP BY 1, 2",
    newest="SELECT facility_id, max(ts) AS last, list(v ORDER BY ts DESC)[1:4] AS l FROM slots GROUP BY 1",
    padded="SELECT facility_id, last, list_concat(l, list_transform(range(0, 4 - len(l)), lambda i: l[len(l)])) AS buf FROM newest",
    # a plain recursion: the row of each step from the one before
    steps="""SELECT * FROM (WITH RECURSIVE s(facility_id, last, step, buf) AS (
      SELECT facility_id, last, 0, buf FROM padded
      UNION ALL
      SELECT facility_id, last, step + 1, list_concat([2.0 + 0.3 * buf[1] + 0.2 * buf[3] + 0.25 * (buf[1] + buf[2] + buf[3] + buf[4]) / 4
        + 0.1 * (buf[1] + buf[2]) / 2 + 1.5 * sin(2 * pi() * hour(last + (step + 1) * INTERVAL 6 HOUR) / 24)
        - 0.5 * cos(2 * pi() * hour(last + (step + 1) * INTERVAL 6 HOUR) / 24)
        + 0.05 * (isodow(last + (step + 1) * INTERVAL 6 HOUR) - 1)], buf[1:3])
      FROM s WHERE step < 7) SELECT * FROM s)"""))
def ml12_refreshed(spark, d):
    """Seven steps with lags, means and the calendar made anew in each."""
    from verdigris.functions.time import time_bucket
    slots = (L.emission_metrics(spark, d).groupBy("facility_id", time_bucket("6 hours", "ts").alias("ts"))
             .agg(F.sum("co2_kg").alias("co2_kg")))
    coefs = {"lag_1": 0.3, "lag_3": 0.2, "mean_4": 0.25, "mean_2": 0.1, "hour_sin": 1.5, "hour_cos": -0.5, "day_of_week": 0.05}
    fc = FC.refreshed_forecast(slots, "co2_kg", 2.0, coefs, 7, step_micros=6 * 3_600_000_000)
    return fc.select("facility_id", "step", "forecast_ts", r("forecast").alias("forecast"))


@register("ml09_rolling_origin_folds", "ML-09", L.with_ctes(f"""
SELECT f.fold, count(*) AS n, {sql_r('avg(abs(v - p))')} AS mae, {sql_r('sqrt(avg((v - p) * (v - p)))')} AS rmse, any_value(t.train_rows) AS train_rows
FROM (SELECT *, 1.0 + 0.6 * lag1 + 0.2 * lag2 AS p FROM folds) f JOIN trained t USING (fold) GROUP BY f.fold""",
    em=L.EMISSION_METRICS_SQL,
    lagged="""SELECT facility_id, ts, co2_kg AS v, lag(co2_kg, 1) OVER w AS lag1, lag(co2_kg, 2) OVER w AS lag2
              FROM em WINDOW w AS (PARTITION BY facility_id ORDER BY ts)""",
    placed="""SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY facility_id) AS c
              FROM lagged WHERE lag2 IS NOT NULL""",
    cuts="SELECT *, floor(c * 0.7 + 1e-9) AS s0, floor(c * 0.8 + 1e-9) AS s1, floor(c * 0.9 + 1e-9) AS s2 FROM placed",
    folds="SELECT *, CASE WHEN i >= s2 THEN 2 WHEN i >= s1 THEN 1 WHEN i >= s0 THEN 0 END AS fold FROM cuts",
    trained="""SELECT 0 AS fold, count(*) AS train_rows FROM folds WHERE i < s0 - 7
               UNION ALL SELECT 1, count(*) FROM folds WHERE i < s1 - 7 UNION ALL SELECT 2, count(*) FROM folds WHERE i < s2 - 7"""))
def ml09_folds(spark, d):
    """Blocks and errors of a given model, and the number of rows that each
    fold is fitted on, which end seven rows before its block."""
    x = FE.lag_features(L.emission_metrics(spark, d), {"co2_kg": [1, 2]}).where(F.col("co2_kg_lag_2").isNotNull())
    folded = FC.rolling_origin(x, 3, 0.3, gap=7)
    scored = folded.withColumn("prediction", 1.0 + 0.6 * F.col("co2_kg_lag_1") + 0.2 * F.col("co2_kg_lag_2"))
    trained = folded.agg(*[F.count_if(F.col("first_fold") <= f).alias(f"n{f}") for f in range(3)])
    trained = trained.select(F.inline(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"n{f}").alias("train_rows")) for f in range(3)])))
    return FC.fold_metrics(scored, "co2_kg").join(trained, "fold").select("fold", "n", r("mae").alias("mae"), r("rmse").alias("rmse"), "train_rows")


@register("ml13_ml16_agg17_attributions", "ML-13")
def ml13(spark, d):
    feats, cols = FC.forecast_features(L.emission_metrics(spark, d), "co2_kg")
    # the seeded sample depends on how the rows lie, so it is drawn before they are stored
    bg = stored(FC.background_means(feats, cols, 0.2), "background")
    feats = stored(feats.select("ts", "facility_id", "co2_kg", *cols), "features")
    res = FC.train_forecaster(feats, cols, "co2_kg", "linear")
    scored = res["model"].transform(feats)
    contrib = FC.linear_contributions(scored, res["model"], cols, bg, ["ts", "facility_id"])
    from verdigris.operators.monitor import feature_importance
    return feature_importance(contrib)


GIVEN = {"co2_kg_lag_1": 0.6, "co2_kg_lag_2": -0.2, "hour_sin": 1.5}
GIVEN_CTES = {
    "em": L.EMISSION_METRICS_SQL,
    "feats": """SELECT *, sin(2 * pi() * hour(ts) / 24) AS hour_sin FROM (
      SELECT facility_id, ts, co2_kg, lag(co2_kg, 1) OVER w AS l1, lag(co2_kg, 2) OVER w AS l2 FROM em
      WINDOW w AS (PARTITION BY facility_id ORDER BY ts)) WHERE l2 IS NOT NULL""",
}


def _given_features(spark, d):
    x = FE.lag_features(L.emission_metrics(spark, d), {"co2_kg": [1, 2]}).where(F.col("co2_kg_lag_2").isNotNull())
    return FE.cyclical_hour(x)


@register("ml13_given_coefficients", "ML-13", L.with_ctes(f"""
SELECT facility_id, ts, {sql_r('0.6 * (l1 - m1)')} AS lag_1, {sql_r('-0.2 * (l2 - m2)')} AS lag_2, {sql_r('1.5 * (hour_sin - m3)')} AS hour_sin
FROM feats, (SELECT avg(l1) AS m1, avg(l2) AS m2, avg(hour_sin) AS m3 FROM feats)""", **GIVEN_CTES))
def ml13_given(spark, d):
    """Contributions of given coefficients, the background being all rows."""
    x = _given_features(spark, d)
    c = FC.given_contributions(x, GIVEN, FC.background_means(x, [*GIVEN], 1.0), ["facility_id", "ts"])
    wide = c.groupBy("facility_id", "ts").pivot("feature", [*GIVEN]).agg(F.first("contribution"))
    return wide.select("facility_id", "ts", r("co2_kg_lag_1").alias("lag_1"), r("co2_kg_lag_2").alias("lag_2"), r("hour_sin").alias("hour_sin"))


@register("agg17_given_importance", "AGG-17", L.with_ctes(f"""
SELECT feature, {sql_r('avg(abs(c))')} AS importance FROM (
  SELECT 'co2_kg_lag_1' AS feature, 0.6 * (l1 - (SELECT avg(l1) FROM feats)) AS c FROM feats
  UNION ALL SELECT 'co2_kg_lag_2', -0.2 * (l2 - (SELECT avg(l2) FROM feats)) FROM feats
  UNION ALL SELECT 'hour_sin', 1.5 * (hour_sin - (SELECT avg(hour_sin) FROM feats)) FROM feats) GROUP BY feature""", **GIVEN_CTES))
def agg17_given(spark, d):
    from verdigris.operators.monitor import feature_importance
    x = _given_features(spark, d)
    c = FC.given_contributions(x, GIVEN, FC.background_means(x, [*GIVEN], 1.0), ["facility_id", "ts"])
    return feature_importance(c).select("feature", r("importance").alias("importance"))


@register("ml15_promotions", "ML-15", L.with_ctes(f"""
SELECT candidate, {sql_r('rmse')} AS candidate_rmse, rmse <= least_before OR least_before IS NULL AS promoted,
       arg_min_before AS old_version, CASE WHEN rmse <= least_before OR least_before IS NULL THEN candidate ELSE arg_min_before END AS production_version
FROM (SELECT candidate, rmse, (SELECT min(rmse) FROM errors b WHERE b.candidate < a.candidate) AS least_before,
             (SELECT arg_min(candidate, rmse) FROM errors b WHERE b.candidate < a.candidate) AS arg_min_before FROM errors a)""",
    **GIVEN_CTES, errors="""SELECT 'v1' AS candidate, sqrt(avg((co2_kg - l1) ** 2)) AS rmse FROM feats
              UNION ALL SELECT 'v2', sqrt(avg((co2_kg - 1.5 * l1) ** 2)) FROM feats
              UNION ALL SELECT 'v3', sqrt(avg((co2_kg - 0.5 * l1 - 0.25 * l2) ** 2)) FROM feats"""))
def ml15_promotions(spark, d):
    """Three versions, the second worse and the third better than the first;
    what production points to after each."""
    from verdigris.operators.monitor import regression_metrics
    x, root, current, out = _given_features(spark, d), scratch_path(spark, "promotions"), None, None
    rules = {"v1": F.col("co2_kg_lag_1"), "v2": 1.5 * F.col("co2_kg_lag_1"), "v3": 0.5 * F.col("co2_kg_lag_1") + 0.25 * F.col("co2_kg_lag_2")}
    for version, rule in rules.items():
        rmse = regression_metrics(x.select(F.col("co2_kg").alias("actual"), rule.alias("predicted"))).first()["rmse"]
        row = FC.promote(spark, root, current, {"version": version, "rmse": rmse})
        pointed = spark.read.json(f"{root}/production").first()["version"]
        current = {"version": version, "rmse": rmse} if pointed == version else current
        row = row.select(F.col("candidate_version").alias("candidate"), r("candidate_rmse").alias("candidate_rmse"), "promoted", "old_version",
                         F.lit(pointed).alias("production_version"))
        out = row if out is None else out.unionByName(row)
    return out


@register("ml05_preprocessor_values", "ML-05", L.with_ctes(f"""
SELECT ts, facility_id, {sql_r('(coalesce(v, med) - m2) / CASE WHEN q3 = q1 THEN 1.0 ELSE q3 - q1 END')} AS value,
       {sql_r('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {', '.join(f"CASE WHEN kind = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kind_{k}" for k in ('click', 'error', 'view'))}
FROM capped, (SELECT median(v) AS med FROM capped),
  (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS m2, quantile_cont(x, 0.75) AS q3
   FROM (SELECT coalesce(v, (SELECT median(v) FROM capped)) AS x FROM capped))""",
    sf=L.SENSOR_FEED_SQL, capped="""SELECT ts, sensor_id AS facility_id, kind, CASE WHEN value IS NOT NULL THEN least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)) END AS v
      FROM sf, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM sf)"""))
def ml05_values(spark, d):
    """A saved and reloaded preprocessor's output for readings, of which the
    failed ones have no value."""
    x = L.sensor_feed(spark, d).select("ts", F.col("sensor_id").alias("facility_id"), "value", "kind")
    path = scratch_path(spark, "preprocessor-values")
    FC.TelemetryPreprocessor(numericCols=["value"], categoricalCols=["kind"]).fit(x).write().overwrite().save(path)
    out = FC.TelemetryPreprocessorModel.load(path).transform(x)
    return out.select("ts", "facility_id", r("value").alias("value"), r("hour_sin").alias("hour_sin"), "kind_click", "kind_error", "kind_view")


@register("ml07_ml14_least_squares", "ML-07", L.with_ctes(f"""
SELECT count(*) AS n, {sql_r('avg(abs(v - p))')} AS mae, {sql_r('sqrt(avg((v - p) * (v - p)))')} AS rmse, {sql_r('stddev_pop(v - p)')} AS sigma
FROM (SELECT co2_kg AS v, a + b * l1 AS p FROM placed, (
        SELECT regr_slope(co2_kg, l1) AS b, regr_intercept(co2_kg, l1) AS a FROM placed WHERE i <= floor(c * 0.8)) WHERE i > floor(c * 0.8))""",
    em=L.EMISSION_METRICS_SQL, lagged="SELECT *, lag(co2_kg, 1) OVER (PARTITION BY facility_id ORDER BY ts) AS l1 FROM em",
    placed="""SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY facility_id) AS c
              FROM lagged WHERE l1 IS NOT NULL"""))
def ml07_least_squares(spark, d):
    """Training without a penalty on one lag is least squares on the first four
    fifths of each series; errors and sigma are those of the last fifth."""
    x = FE.lag_features(L.emission_metrics(spark, d), {"co2_kg": [1]}).where(F.col("co2_kg_lag_1").isNotNull())
    res = FC.train_forecaster(x, ["co2_kg_lag_1"], "co2_kg", "linear", reg_param=0.0)
    return res["metrics"].select("n", r("mae").alias("mae"), r("rmse").alias("rmse"), r(F.lit(res["sigma"])).alias("sigma"))


@register("ml10_ml11_known_model", "ML-10", L.with_ctes(f"""
SELECT reading_id, {sql_r('2 * value + 1')} AS prediction FROM sf WHERE value IS NOT NULL""", sf=L.SENSOR_FEED_SQL))
def ml10_known(spark, d):
    """A model that is known, saved as a second version and promoted, loaded as
    production and scored over a Parquet table (SET-03)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    known = L.sensor_feed(spark, d).where("value is not null").select("reading_id", "value", (2 * F.col("value") + 1).alias("label"),
                                                                      (5 - F.col("value")).alias("wrong"))
    root, data = scratch_path(spark, "known-models"), scratch_path(spark, "known-readings")
    known.select("reading_id", "value").write.parquet(data)
    current = None
    for version, label, rmse in (("v1", "wrong", 9.0), ("v2", "label", 0.5)):
        model = Pipeline(stages=[VectorAssembler(inputCols=["value"], outputCol="features"), LinearRegression(labelCol=label)]).fit(known)
        FC.save_version(spark, model, root, version, {"rmse": rmse})
        FC.promote(spark, root, current, {"version": version, "rmse": rmse})
        current = {"version": version, "rmse": rmse}
    scored = FC.score_parquet(spark, FC.load_version(spark, root), data)
    return scored.select("reading_id", r("prediction").alias("prediction"))
