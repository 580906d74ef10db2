"""Distributed CO2e forecasting on ``pyspark.ml`` (ML-05, ML-07..16,
WIN-13, AGG-17).

Training runs as Spark ML jobs over the feature table (WIN-02/03 + PRJ-08/10
features built with window functions).  The only Python per-group code is
the recursive multi-step forecast (ML-12), which sees just the last
``max(lags)`` rows of each series, so its groups are bounded whatever the
history length.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.time import epoch_micros
from verdigris.operators import features as FE
from verdigris.operators.monitor import regression_metrics

# ---------------------------------------------------------------- ML-05


class _PrepParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric input columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical input columns",
                            TypeConverters.toListString)
    timestampCol = Param(Params._dummy(), "timestampCol", "event time column", TypeConverters.toString)
    refitOutliers = Param(Params._dummy(), "refitOutliers",
                          "recompute IQR caps on each transformed batch (literal behaviour)",
                          TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], timestampCol="ts", refitOutliers=False)


class TelemetryPreprocessor(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fit: IQR caps (ML-01), median + IQR robust scaling statistics computed
    after imputation (ML-02), category vocabularies (ML-03).  The fitted
    state is a handful of numbers per column."""

    @keyword_only
    def __init__(self, numericCols=None, categoricalCols=None, timestampCol="ts", refitOutliers=False):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "TelemetryPreprocessorModel":
        num = self.getOrDefault("numericCols")
        cat = self.getOrDefault("categoricalCols")
        state = {"caps": {}, "robust": {}, "vocab": {}}
        if num:
            for row in FE.fit_iqr_caps(df, num).collect():          # one row per column
                state["caps"][row["column"]] = [row["lower"], row["upper"]]
            capped = df
            for c, (lo, hi) in state["caps"].items():
                capped = capped.withColumn(c, FE.clipped(F.col(c), F.lit(lo), F.lit(hi)))
            for row in FE.fit_robust(capped, num).collect():
                state["robust"][row["column"]] = [row["fill"], row["center"], row["scale"]]
        if cat:
            state["vocab"] = FE.fit_categories(df, cat)
        m = TelemetryPreprocessorModel(stateJson=json.dumps(state))
        m._set(numericCols=num, categoricalCols=cat, timestampCol=self.getOrDefault("timestampCol"),
               refitOutliers=self.getOrDefault("refitOutliers"))
        return m


class TelemetryPreprocessorModel(Model, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    stateJson = Param(Params._dummy(), "stateJson", "fitted statistics as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, stateJson="{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault("stateJson"))
        num = self.getOrDefault("numericCols")
        ts = self.getOrDefault("timestampCol")
        out = df
        if ts in df.columns:
            out = FE.cyclical_hour(FE.calendar_features(out, ts), ts)
        for c in num:
            if self.getOrDefault("refitOutliers"):
                out = FE.apply_iqr_caps(out, FE.fit_iqr_caps(out, [c]), [c])
            else:
                lo, hi = state["caps"][c]
                out = out.withColumn(c, FE.clipped(F.col(c), F.lit(lo), F.lit(hi)))
            fill, center, scale = state["robust"][c]
            out = out.withColumn(c, (F.coalesce(F.col(c), F.lit(fill)) - F.lit(center)) / F.lit(scale))
        if state["vocab"]:
            out = FE.one_hot(out, state["vocab"])
        return out


# ---------------------------------------------------------------- features
DEFAULT_LAGS = (1, 2, 3)
DEFAULT_MEANS = (6,)


def forecast_features(df: DataFrame, value: str, key: str = "facility_id", ts: str = "ts",
                      lags: Sequence[int] = DEFAULT_LAGS, means: Sequence[int] = DEFAULT_MEANS,
                      tiebreak: str | None = None) -> tuple[DataFrame, list[str]]:
    """Lag and rolling-mean features of the *previous* rows (no leakage of
    the target) plus calendar/cyclical hour; rows without full history are
    dropped."""
    from verdigris.operators import series as S
    cols = [f"{value}_lag_{k}" for k in lags] + [f"{value}_prev_mean_{n}" for n in means]

    def build(w):
        out = [F.lag(value, k).over(w).alias(f"{value}_lag_{k}") for k in lags]
        for n in means:
            wn = w.rowsBetween(-n, -1)
            out.append(F.when(F.count(value).over(wn) == n, F.avg(value).over(wn)).alias(f"{value}_prev_mean_{n}"))
        return out
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    out = S.apply_framed(df, key, order, build, back=max(list(lags) + list(means)), ts=ts)
    out = FE.cyclical_hour(FE.calendar_features(out, ts), ts)
    cols += ["hour_sin", "hour_cos", "day_of_week"]
    out = out.withColumn("day_of_week", F.col("day_of_week").cast("double"))
    return out.dropna(subset=cols), cols


# ---------------------------------------------------------------- ML-07/08/14
def train_forecaster(features: DataFrame, feature_cols: Sequence[str], label: str, algo: str = "linear",
                     split: str = "chronological", test_size: float = 0.2, seed: int = 42,
                     key: str = "facility_id", ts: str = "ts", max_iter: int = 50,
                     validation_tol: float = 0.01, reg_param: float = 0.01) -> dict:
    """Train and validate.  ``split='chronological'`` holds out the last
    ``test_size`` share of each series (no window leakage, WIN-12);
    ``'random'`` is the seeded 80/20 split.  GBT uses a validation column
    for early stopping (ML-08); ``reg_param`` is the linear model's.  Returns model, validation metrics (AGG-14)
    and the residual sigma used for intervals (ML-14).

    Label, features and split are stored once: the passes of the fit and those
    of the validation read them.  ``features`` itself is read twice (positions
    and their counts); store it first if it is costly."""
    from verdigris.functions.quantiles import stored
    if split == "random":
        train, test = features.randomSplit([1 - test_size, test_size], seed)
        data = train.withColumn("is_val", F.lit(False)).unionByName(test.withColumn("is_val", F.lit(True)))
    else:
        from verdigris.operators import series as S
        pos = S.positions(features.select(*dict.fromkeys([key, ts, *feature_cols, label])), key, [F.col(ts)], ts=ts)
        data = pos.withColumn("is_val", F.col("_i") + 1 > F.floor(F.col("_n") * (1 - test_size))).drop("_i", "_n")
    data = stored(data.select(*dict.fromkeys([*feature_cols, label]), "is_val"), "train-split")
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="skip")
    if algo == "gbt":
        reg = GBTRegressor(labelCol=label, maxIter=max_iter, seed=seed, validationIndicatorCol="is_val",
                           validationTol=validation_tol, maxDepth=4)
        model = Pipeline(stages=[asm, reg]).fit(data)
    else:
        reg = LinearRegression(labelCol=label, maxIter=max_iter, regParam=reg_param)
        model = Pipeline(stages=[asm, reg]).fit(data.filter(~F.col("is_val")))
    val = model.transform(data.filter(F.col("is_val")))
    val = val.select(F.col(label).alias("actual"), F.col("prediction").alias("predicted"))
    metrics = regression_metrics(val)
    sigma = val.agg(F.stddev_pop(F.col("actual") - F.col("predicted"))).first()[0] or 0.0
    return {"model": model, "metrics": metrics, "sigma": float(sigma)}


def rolling_origin(features: DataFrame, folds: int = 3, test_size: float = 0.3, gap: int = 0, key: str = "facility_id",
                   ts: str = "ts", tiebreak: str | None = None) -> DataFrame:
    """Chronological folds for validation: the last ``test_size`` share of
    each series is cut into ``folds`` blocks; block f (column ``fold``, NULL
    before the blocks) validates what was fitted on the rows that end at least
    ``gap`` rows before it.  Choose the gap as window + horizon and no training
    window overlaps a validation row.  ``first_fold`` is the first fold that the
    row may train (NULL: none); ``train_rows`` and ``fold`` select.  Positions
    come without a series-wide sort."""
    from verdigris.operators import series as S
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    pos = S.positions(features, key, order, ts=ts)
    starts = [F.floor(F.col("_n") * (1 - test_size + test_size * f / folds) + 1e-9) for f in range(folds)]
    fold = F.when(F.lit(False), F.lit(0))
    first = F.when(F.lit(False), F.lit(0))
    for f in range(folds):
        first = first.when(F.col("_i") < starts[f] - gap, F.lit(f))
    for f in reversed(range(folds)):
        fold = fold.when(F.col("_i") >= starts[f], F.lit(f))
    return pos.withColumn("fold", fold).withColumn("first_fold", first).drop("_i", "_n")


def train_rows(folded: DataFrame, fold: int) -> DataFrame:
    """Rows that a fold is fitted on."""
    return folded.where(F.col("first_fold") <= fold)


def fold_metrics(scored: DataFrame, actual: str, predicted: str = "prediction") -> DataFrame:
    """n, mae and rmse of each validation block."""
    off = F.col(actual) - F.col(predicted)
    return (scored.where(F.col("fold").isNotNull()).groupBy("fold")
            .agg(F.count("*").alias("n"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse")).orderBy("fold"))


@dataclass
class Tuned:
    """Outcome of ``tune``: the parameter maps, the mean validation RMSE of
    each, the best one's index, and its model fitted on all rows."""

    params: list[dict]
    validationMetrics: list[float]
    best: int
    bestModel: PipelineModel


#: Parameters that ``tune`` tries by default.
GRID = [{"regParam": p, "elasticNetParam": e} for p in (0.0, 0.01, 0.1) for e in (0.0, 0.5)]


def tune(features: DataFrame, feature_cols: Sequence[str], label: str, parallelism: int = 4, seed: int = 42,
         grid: Sequence[dict] = GRID, folds: int = 3, gap: int = 30, key: str = "facility_id", ts: str = "ts",
         tiebreak: str | None = None) -> Tuned:
    """ML-07 / ML-09: grid search over a declared space, validated by rolling
    origin (``rolling_origin``): every fit sees rows before its validation
    block only, with a gap between.  Folds and features are stored once; fits
    run ``parallelism`` at a time.  ``seed`` is kept for callers; nothing is
    random."""
    from verdigris.functions.quantiles import stored
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="skip")
    folded = rolling_origin(features.select(key, ts, *([tiebreak] if tiebreak else []), *feature_cols,
                                            *([label] if label not in feature_cols else [])), folds, 0.3, gap, key, ts, tiebreak)
    folded = stored(folded, "tune-folds")

    def fit(rows: DataFrame, params: dict) -> PipelineModel:
        return Pipeline(stages=[asm, LinearRegression(labelCol=label, maxIter=50, **params)]).fit(rows)

    def error(task) -> float:
        params, f = task
        scored = fit(train_rows(folded, f), params).transform(folded.where(F.col("fold") == f))
        return scored.agg(F.sqrt(F.avg((F.col(label) - F.col("prediction")) ** 2))).first()[0]

    tasks = [(p, f) for p in grid for f in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        errors = [*pool.map(error, tasks)]
    means = [sum(errors[i:i + folds]) / folds for i in range(0, len(errors), folds)]
    best = min(range(len(means)), key=means.__getitem__)
    return Tuned([dict(p) for p in grid], means, best, fit(folded, grid[best]))


# ---------------------------------------------------------------- ML-10/15
def save_version(spark: SparkSession, model: PipelineModel, root: str, version: str, metadata: dict) -> str:
    """ML-10: ``root/version/model`` plus a one-row metadata table."""
    path = f"{root.rstrip('/')}/{version}"
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(version, json.dumps(metadata))], "version string, metadata string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return path


def load_version(spark: SparkSession, root: str, version: str = "production") -> PipelineModel:
    """Load a version; ``production`` follows the pointer row."""
    if version == "production":
        version = spark.read.json(f"{root.rstrip('/')}/production").first()["version"]
    return PipelineModel.load(f"{root.rstrip('/')}/{version}/model")


def promote(spark: SparkSession, root: str, current: dict | None, candidate: dict) -> DataFrame:
    """ML-15: switch the production pointer to the candidate only if its
    validation RMSE is not worse; returns the decision row."""
    better = current is None or candidate["rmse"] <= current["rmse"]
    new = candidate["version"] if better else current["version"]
    row = spark.createDataFrame([(current["version"] if current else None, candidate["version"], better, new,
                                  float(candidate["rmse"]))],
                                "old_version string, candidate_version string, promoted boolean, "
                                "production_version string, candidate_rmse double")
    spark.createDataFrame([(new,)], "version string").coalesce(1).write.mode("overwrite").json(
        f"{root.rstrip('/')}/production")
    return row


# ---------------------------------------------------------------- ML-11
def score_parquet(spark: SparkSession, model: PipelineModel, path: str) -> DataFrame:
    """ML-11: batch-score a Parquet file (SET-03: batches are partitions)."""
    return model.transform(spark.read.parquet(path))


# ---------------------------------------------------------------- ML-12 / WIN-13
def linear_coefficients(model: PipelineModel) -> tuple[float, list[float]]:
    lr = model.stages[-1]
    return float(lr.intercept), [float(c) for c in lr.coefficients]


def recursive_forecast(history: DataFrame, value: str, intercept: float, coefs: Sequence[float],
                       steps: int, key: str = "facility_id", ts: str = "ts", step_interval: str = "1 hour",
                       tiebreak: str | None = None) -> DataFrame:
    """ML-12: autoregressive multi-step forecast; each prediction becomes the
    newest lag for the next step.  ``coefs[i]`` multiplies lag ``i+1``.

    Only the last ``len(coefs)`` rows of each series are kept (a row_number <=
    k filter, planned as a group limit), so a long or hot series never lands
    whole in one task; the recursion is a fold over the steps within the row.
    A series shorter than that has its oldest value for the lags before it."""
    k = len(coefs)
    order = [F.desc(ts)] + ([F.desc(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(key).orderBy(*order)
    tail = (history.select(key, ts, *([tiebreak] if tiebreak else []), F.col(value).cast("double").alias("_v"))
                   .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k))
    known = F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_v"))), lambda x: x["_v"])
    series = tail.groupBy(key).agg(F.max(ts).alias("_last"), known.alias("_k"))
    lags = F.concat("_k", F.array_repeat(F.element_at("_k", -1), F.lit(k) - F.size("_k")))
    start = F.struct(lags.alias("lags"), F.array().cast("array<double>").alias("out"))

    def one(acc, _):
        terms = [F.lit(float(c)) * acc["lags"][i] for i, c in enumerate(coefs)]
        pred = sum(terms[1:], terms[0]) + F.lit(float(intercept)) if terms else F.lit(float(intercept))
        newer = F.slice(F.concat(F.array(pred), acc["lags"]), 1, max(k, 1))
        return F.struct(newer.alias("lags"), F.array_append(acc["out"], pred).alias("out"))

    out = series.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, one, lambda acc: acc["out"]))
    return (out.select(key, "_last", F.posexplode("_f").alias("_p", "forecast"))
               .select(key, (F.col("_p") + 1).alias("step"),
                       (F.col("_last") + F.expr(f"INTERVAL {step_interval}") * (F.col("_p") + 1)).cast("timestamp_ntz").alias("forecast_ts"),
                       "forecast"))


def refreshed_forecast(history: DataFrame, value: str, intercept: float, coefs: Mapping[str, float], steps: int,
                       key: str = "facility_id", ts: str = "ts", step_micros: int = 3_600_000_000,
                       tiebreak: str | None = None) -> DataFrame:
    """ML-12 / WIN-13 for models on all features of ``forecast_features``: each
    prediction becomes the newest value, and all features are made anew for
    the next step.  ``coefs`` maps ``lag_k`` (the k-th newest value),
    ``mean_n`` (mean of the n newest), ``hour_sin``, ``hour_cos`` and
    ``day_of_week`` (0 = Monday) to coefficients; ``forecast_row`` gives them
    for a fitted model.

    Only the newest values of each series are kept (as many as the longest lag
    or mean; a group limit before the shuffle), and the recursion is a fold
    within the row that carries a buffer of them, a running sum for each mean
    and the time of the next row.  A series shorter than that has its oldest
    value for those before it; null values and rows without a time are left
    out."""
    lags = {int(c[4:]): float(v) for c, v in coefs.items() if c.startswith("lag_")}
    means = {int(c[5:]): float(v) for c, v in coefs.items() if c.startswith("mean_")}
    unknown = set(coefs) - {f"lag_{k}" for k in lags} - {f"mean_{n}" for n in means} - {"hour_sin", "hour_cos", "day_of_week"}
    if unknown:
        raise ValueError(f"no feature for {sorted(unknown)}")
    size = max([*lags, *means, 1])
    order = [F.desc(ts)] + ([F.desc(tiebreak)] if tiebreak else [])
    tail = (history.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
            .select(key, ts, *([tiebreak] if tiebreak else []), F.col(value).cast("double").alias("_v"))
            .withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rn") <= size))
    known = F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_v"))), lambda x: x["_v"])
    series = tail.groupBy(key).agg(F.max(ts).cast("timestamp_ntz").alias("_last"), known.alias("_k"))
    series = series.withColumn("_buffer", F.concat("_k", F.array_repeat(F.element_at("_k", -1), F.lit(size) - F.size("_k"))))
    total = [F.aggregate(F.slice("_buffer", 1, n), F.lit(0.0), lambda a, x: a + x).alias(f"s{n}") for n in means]
    start = F.struct(F.col("_buffer").alias("buffer"), F.struct(F.lit(0).alias("none"), *total).alias("sums"),
                     F.array().cast("array<double>").alias("out"))
    begin = epoch_micros("_last")

    def one(acc, step):
        at = begin + step.cast("bigint") * F.lit(step_micros).cast("bigint")
        angle = F.lit(2 * math.pi / 24) * (F.floor(at / F.lit(3_600_000_000.0)) % 24)
        features = {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle),
                    "day_of_week": F.pmod(F.floor(at / F.lit(86_400_000_000.0)) + 3, F.lit(7)).cast("double")}  # 1970-01-01 was a Thursday
        features |= {f"lag_{k}": F.get(acc["buffer"], F.lit(k - 1)) for k in lags}
        features |= {f"mean_{n}": acc["sums"][f"s{n}"] / F.lit(float(n)) for n in means}
        pred = F.lit(float(intercept))
        for name, c in coefs.items():
            pred = pred + F.lit(float(c)) * features[name]
        sums = [(acc["sums"][f"s{n}"] + pred - F.get(acc["buffer"], F.lit(n - 1))).alias(f"s{n}") for n in means]
        newer = F.slice(F.concat(F.array(pred), acc["buffer"]), 1, size)
        return F.struct(newer.alias("buffer"), F.struct(F.lit(0).alias("none"), *sums).alias("sums"),
                        F.array_append(acc["out"], pred).alias("out"))

    out = series.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, one, lambda acc: acc["out"]))
    return (out.select(key, "_last", F.posexplode("_f").alias("_p", "forecast"))
               .select(key, (F.col("_p") + 1).alias("step"),
                       F.timestamp_add("MICROSECOND", (F.col("_p") + 1).cast("bigint") * F.lit(step_micros).cast("bigint"), F.col("_last"))
                       .alias("forecast_ts"), "forecast"))


def forecast_row(model: PipelineModel, feature_cols: Sequence[str], value: str) -> tuple[float, dict[str, float]]:
    """Intercept and coefficients of a linear model on ``forecast_features``,
    by the names that ``refreshed_forecast`` takes."""
    intercept, coefs = linear_coefficients(model)
    names = [c.removeprefix(f"{value}_").replace("prev_mean_", "mean_") for c in feature_cols]
    return intercept, dict(zip(names, coefs, strict=True))


# ---------------------------------------------------------------- ML-13/16, AGG-17
def background_means(features: DataFrame, feature_cols: Sequence[str], fraction: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """ML-16: per-feature means of a seeded background sample."""
    return features.sample(fraction=fraction, seed=seed).agg(*[F.avg(c).alias(c) for c in feature_cols])


def linear_contributions(scored: DataFrame, model: PipelineModel, feature_cols: Sequence[str],
                         background: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """ML-13: contribution_j = coef_j (x_j - mean_j), long format; per row
    the contributions sum to prediction - prediction(mean)."""
    _, coefs = linear_coefficients(model)
    return given_contributions(scored, dict(zip(feature_cols, coefs, strict=True)), background, [*id_cols, "prediction"])


def given_contributions(rows: DataFrame, coefs: Mapping[str, float], background: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """``linear_contributions`` by given coefficients of features."""
    from verdigris.operators.joins import one_row
    bg = one_row(background.select(*coefs))            # per-feature means, one row
    items = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(float(k)) * (F.col(c) - bg[c])).alias("contribution"))
                      for c, k in coefs.items()])
    return rows.select(*id_cols, F.inline(items))
