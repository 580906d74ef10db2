"""Incremental roll-ups, interval joins, equal-depth buckets, dense windows,
stored sketches, deep pages, validation folds, forecasts and stream state,
each against a plain version on small awkward tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def metrics(spark):
    """A month of readings of four facilities (one of them null), half of them
    of one facility; null values and times, repeated rows."""
    r, rows = random.Random(1), []
    for i in range(3000):
        t = T0 + dt.timedelta(seconds=r.randrange(30 * 86400))
        rows.append((i, t if i % 101 else None, None if i % 97 == 0 else r.choice([7, 7, 7, 8, 9]),
                     None if i % 53 == 0 else round(r.gauss(0, 50), 2), r.random()))
    rows += rows[:20]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, facility_id long, co2_kg double, anomaly_score double").cache()


# --- AGG-19

def daily(metrics):
    from verdigris.operators import rollups as RU
    s = RU.partial_states(metrics)
    return {(r.bucket, r.facility_id): (r.n, r.value_n, r.value_min, r.value_max) for r in s.collect()}


def test_nights_equal_the_batch_with_late_rows_retries_and_failures(spark, metrics, tmp_path):
    from verdigris.operators import rollups as RU
    root = str(tmp_path / "t")
    noon = T0 + dt.timedelta(hours=12)
    late = F.when(F.col("event_id") % 29 == 0, 5).otherwise(0)
    night = F.coalesce(F.floor(F.datediff(F.timestamp_add("HOUR", F.lit(12), F.col("ts")), F.lit(noon.date())) / 6) + late, F.lit(2))
    dealt = metrics.withColumn("night", night).cache()
    for n in sorted(r.night for r in dealt.select("night").distinct().collect()):
        RU.record_arrivals(dealt.where(F.col("night") == n), root, f"n{n}")
        if n == 1:  # this night does not run: the next one takes its days up
            continue
        days = RU.roll_up_changes(spark, root, f"n{n}")
        assert RU.roll_up_changes(spark, root, f"again-{n}") == []
        if n == 3:  # an arrival that is retried after its night changes nothing
            RU.record_arrivals(dealt.where(F.col("night") == n), root, f"n{n}")
        assert len(days) < 31
    got = RU.rolled_up(spark, root)
    want = daily(metrics)
    assert {(r.bucket, r.facility_id): r.n for r in got.collect()} == {k: v[0] for k, v in want.items()}
    sums = {(r.bucket, r.facility_id): r.s for r in metrics.where("ts is not null").groupBy(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket"), "facility_id").agg(F.sum("co2_kg").alias("s")).collect()}
    for r in got.collect():
        key = (r.bucket, r.facility_id)
        assert (r.value_min, r.value_max) == want[key][2:]
        assert r.total_co2 is None and sums[key] is None or abs(r.total_co2 - sums[key]) < 1e-6
    some = RU.rolled_up(spark, root, "2024-01-05", "2024-01-07")
    assert {r.day.day for r in some.collect()} == {5, 6, 7}


def test_recomputed_rollup_never_cuts_a_day(spark, metrics, tmp_path):
    from verdigris.operators.reports import nightly_rollup
    path, known = str(tmp_path / "r"), metrics.where("ts is not null")
    for day in range(8, 30, 3):
        at = T0 + dt.timedelta(days=day, hours=12)
        nightly_rollup(known.where(F.col("ts") <= F.lit(at)), path, at, days=7)
    got = {(r.bucket, r.facility_id): r.total_co2 for r in spark.read.parquet(path).collect()}
    last = T0 + dt.timedelta(days=29, hours=12)
    want = known.where((F.col("ts") <= F.lit(last)) & (F.col("ts") >= F.lit(T0 + dt.timedelta(days=1)))).groupBy(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("b"), "facility_id").agg(F.sum("co2_kg").alias("s")).collect()
    for r in want:
        assert r.s is None and got[r.b, r.facility_id] is None or abs(got[r.b, r.facility_id] - r.s) < 1e-6


def test_compacted_arrivals_count_once(spark, metrics, tmp_path):
    from verdigris.operators import rollups as RU
    root = str(tmp_path / "c")
    assert RU.compact(spark, root) == 0
    dealt = [metrics.where(F.pmod("event_id", F.lit(4)) == n) for n in range(4)]
    RU.record_arrivals(dealt[0], root, "r0")
    RU.record_arrivals(dealt[1], root, "r1")
    assert RU.compact(spark, root) == 1 and RU.compact(spark, root) == 1
    assert RU._folders(spark, f"{root}/arrivals") == []
    RU.record_arrivals(dealt[1], root, "r1")  # retried after the compaction
    RU.record_arrivals(dealt[2], root, "r2")
    RU.roll_up_changes(spark, root, "n0")
    # a compaction that fails before its list of runs is written leaves no trace
    RU.merged(RU._states(spark, root)).withColumn("day", F.to_date("bucket")).write.partitionBy("day").parquet(f"{root}/base/version=2")
    RU.record_arrivals(dealt[3], root, "r3")
    assert RU.compact(spark, root) == 2
    assert RU._folders(spark, f"{root}/base") == ["version=2"] and RU._folders(spark, f"{root}/arrivals") == []
    RU.roll_up_changes(spark, root, "n1")
    got = {(r.bucket, r.facility_id): (r.n, r.value_min, r.value_max) for r in RU.rolled_up(spark, root).collect()}
    assert got == {k: (v[0], *v[2:]) for k, v in daily(metrics).items()}


def test_rollup_of_nothing(spark, metrics, tmp_path):
    from verdigris.operators import rollups as RU
    root = str(tmp_path / "e")
    assert RU.roll_up_changes(spark, root, "a") == []
    RU.record_arrivals(metrics.limit(0), root, "a")
    assert RU.roll_up_changes(spark, root, "a") == []


# --- JOIN-05

def test_dyadic_cover_is_the_interval(spark):
    from verdigris.operators.intervals import dyadic_cover
    r = random.Random(2)
    pairs = [(a, a + r.choice([0, 1, 5, 100, 3000])) for a in (r.randrange(5000) for _ in range(60))] + [(4, 3), (0, (1 << 22) - 1), (7, 7)]
    for row in spark.createDataFrame(pairs, "a long, b long").withColumn("c", dyadic_cover(F.col("a"), F.col("b"))).collect():
        slots = [s for n in row.c for s in (n.node << n.level, ((n.node + 1) << n.level) - 1)]
        covered = sorted((n.node << n.level, ((n.node + 1) << n.level) - 1) for n in row.c)
        if row.a > row.b:
            assert not slots
        else:
            assert covered[0][0] == row.a and covered[-1][1] == row.b and len(covered) <= 2 * 22
            assert all(x[1] + 1 == y[0] for x, y in zip(covered, covered[1:], strict=False))


def test_interval_lookup_equals_a_plain_join(spark):
    from verdigris.operators.intervals import interval_lookup
    r = random.Random(3)

    def at():
        return T0 + dt.timedelta(minutes=r.randrange(400 * 1440))
    events = [(i, r.choice(["a", "a", "b", None]), at() if i % 31 else None) for i in range(500)] + [(900, "a", dt.datetime(9000, 1, 1)), (901, "a", dt.datetime(1, 1, 2))]
    versions = []
    for i in range(300):
        a = at()
        versions.append((r.choice(["a", "b", None]), a if i % 41 else None, r.choice([None, a, a + dt.timedelta(minutes=r.randrange(1, 90000)), a - dt.timedelta(days=1)]), float(i)))
    versions += [("a", dt.datetime(1, 1, 1), dt.datetime(1, 1, 3), -1.0), ("a", dt.datetime(8000, 1, 1), None, -2.0)]
    e = spark.createDataFrame(events, "id long, k string, ts timestamp_ntz")
    v = spark.createDataFrame(versions, "code string, effective_from timestamp_ntz, effective_to timestamp_ntz, f double")
    for slot in (86_400_000_000, 3_600_000_000 * 5):
        got = interval_lookup(e, v, "k", "code", ["f"], slot_micros=slot)
        on = ((F.col("k") == F.col("code")) & (F.col("ts") >= F.col("effective_from"))
              & (F.col("effective_to").isNull() | (F.col("ts") < F.col("effective_to"))))
        assert rows_of(got.select("id", "f")) == rows_of(e.join(v, on, "left").select("id", "f"))
    assert interval_lookup(e, v.limit(0), "k", "code", ["f"]).where("f is not null").count() == 0
    assert interval_lookup(e.limit(0), v, "k", "code", ["f"]).count() == 0


# --- WIN-02..12 with equal-depth buckets, WIN-09 / 10 as slices

@pytest.fixture(scope="module")
def crowded(spark):
    """A series with nine tenths of its rows in an hour, others sparse; ties
    in time, a null facility, rows without a time, null values."""
    r, rows = random.Random(4), []
    for i in range(4000):
        t = T0 + (dt.timedelta(hours=200, seconds=r.randrange(3600)) if i % 10 else dt.timedelta(minutes=r.randrange(90 * 1440)))
        rows.append((i, None if i % 499 == 0 else t, r.choice(["p", "p", "p", "q", None]) if i % 10 else "s", None if i % 17 == 0 else r.random()))
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, k string, v double").cache()


@pytest.mark.parametrize("within", [None, "month", "day"])
def test_equal_depth_windows_equal_plain_windows(crowded, within):
    from verdigris.operators import features as FE
    from verdigris.operators import series as S
    bucket, order = S.EqualDepth(100, within), [F.col("ts"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    plain = crowded.select("id", F.lag("v", 1).over(w).alias("a"), F.lag("v", 30).over(w).alias("b"),
                           F.lead("v", 7).over(w).alias("c"), (F.row_number().over(w) - 1).alias("p"),
                           F.count("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    got = S.apply_framed(crowded, "k", order, lambda x: [F.lag("v", 1).over(x).alias("a"), F.lag("v", 30).over(x).alias("b"),
                                                         F.lead("v", 7).over(x).alias("c")], back=30, ahead=7, bucket=bucket, keep_positions=True)
    n = S.running_sum(crowded, "k", order, F.col("v").isNotNull().cast("long"), "n", bucket)
    got = got.select("id", "a", "b", "c", F.col("_i").alias("p")).join(n.select("id", "n"), "id")
    assert rows_of(got) == rows_of(plain)
    a = FE.interpolate_linear(crowded, "v", "k", tiebreak="id", bucket=bucket)
    b = FE.interpolate_linear(crowded, "v", "k", tiebreak="id", bucket=None)
    assert rows_of(a.select("id", "v")) == rows_of(b.select("id", "v"))


def test_a_crowded_hour_is_spread_over_buckets(crowded):
    from verdigris.operators import series as S
    sizes = S._bucketed(crowded, ["k"], S.EqualDepth(100), "ts").groupBy("k", "_b").count().collect()
    by_day = crowded.groupBy("k", F.to_date("ts")).count().agg(F.max("count")).first()[0]
    assert by_day > 1500 and max(r["count"] for r in sizes) < 300
    assert len([r for r in sizes if r.k == "s"]) < 30  # and sparse days share buckets


def brute_windows(rows, window, horizon, drop_last):
    series = {}
    for i, t, k, v in rows:
        series.setdefault(k, []).append(((t is not None, t or T0, i), t, v))
    out = []
    for k, s in series.items():
        s.sort(key=lambda x: x[0])
        last = len(s) - window - horizon + 1 - drop_last
        for a in range(max(0, last)):
            y = [x[2] for x in s[a + window:a + window + horizon]]
            if None not in y:
                out.append((k, s[a][1], [x[2] for x in s[a:a + window]], y))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "horizon", "drop_last"), [(5, 2, False), (12, 1, True), (1, 1, False)])
def test_training_windows_equal_brute_force(crowded, window, horizon, drop_last):
    from verdigris.operators import features as FE
    from verdigris.operators import series as S
    want = brute_windows([tuple(r) for r in crowded.collect()], window, horizon, drop_last)
    for bucket in ("day", None, S.EqualDepth(100)):
        got = FE.training_windows(crowded, ["v"], "v", window, horizon, "k", "ts", "id", drop_last, bucket)
        got = got.select("k", "window_start", F.transform("x", lambda e: e["v"]).alias("x"), "y")
        assert sorted(((r.k, r.window_start, r.x, r.y) for r in got.collect()), key=repr) == want


def test_training_windows_shuffle_does_not_grow_with_the_window(crowded):
    from verdigris.operators import features as FE
    sizes = [FE.dense_series(crowded, ["v"], "v", ahead, "k", "ts", "id").agg(F.sum(F.size("x"))).first()[0] for ahead in (1, 10)]
    assert sizes[1] < 3 * sizes[0]


def test_dense_rows_stay_small_when_a_second_holds_a_series(spark):
    """1,500 rows of one time, which no bucket of times can part."""
    from verdigris.operators import features as FE
    from verdigris.operators import series as S
    rows = [(i, T0, "k", None if i == 700 else float(i * 37 % 1500)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, k string, v double")
    for bucket in ("day", S.EqualDepth(100)):
        dense = FE.dense_series(df, ["v"], "v", 6, "k", "ts", "id", bucket).select(F.size("x").alias("size"), "own", "i", "n").collect()
        assert max(r["size"] for r in dense) <= FE.DENSE_ROWS + 6 and sum(r.own for r in dense) == 1500
        assert sorted(r.i for r in dense) == [*range(0, 1500, FE.DENSE_ROWS)] and {r.n for r in dense} == {1500}
        got = FE.training_windows(df, ["v"], "v", 5, 2, "k", "ts", "id", False, bucket)
        got = got.select("k", "window_start", F.transform("x", lambda e: e["v"]).alias("x"), "y")
        assert sorted(((r.k, r.window_start, r.x, r.y) for r in got.collect()), key=repr) == brute_windows(rows, 5, 2, False)


# --- AGG-05 by daily sketches

def test_sketched_medians_equal_the_definition(spark, metrics, tmp_path):
    from verdigris.operators import daysketch as DS
    root = str(tmp_path / "s")
    for low, high in ((0, 12), (12, 20), (19, 31)):  # a day that is kept again is replaced
        days = F.dayofmonth("ts") - 1
        DS.sketch_days(metrics.where((days >= low) & (days < high)), root)
    for as_of, n in ((T0 + dt.timedelta(days=20, hours=13), 7), (T0 + dt.timedelta(days=30), 7), (T0 + dt.timedelta(days=9), 3)):
        rows = [r for r in metrics.where(F.col("co2_kg").isNotNull()).collect()
                if r.ts is not None and as_of - dt.timedelta(days=n) < r.ts and r.ts.date() <= as_of.date()]
        got = {r.facility_id: (r.median_co2, r.mad_co2) for r in DS.trailing_stats(spark, root, metrics, as_of, n).collect()}
        want = {}
        for k in {r.facility_id for r in rows}:
            def middle(x):
                x = sorted(x)
                return x[(len(x) - 1) // 2] + 0.5 * (x[len(x) // 2] - x[(len(x) - 1) // 2])
            v = [r.co2_kg for r in rows if r.facility_id == k]
            m = middle(v)
            want[k] = (m, middle(abs(x - m) for x in v))
        assert got.keys() == want.keys()
        for k in want:
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want[k], strict=True))


def test_bins_follow_the_order_of_values(spark):
    from verdigris.operators.daysketch import bin_of
    values = sorted([0.0, 5e-324, 1e-300, 1.0, 1.019, 1.021, 1e308, -1e308, -2.0, -1e-300, 123.456, -0.0])
    bins = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(bin_of(F.col("v"))).collect()]
    assert bins == sorted(bins) and bins[0] < 0 < bins[-1]


# --- SRT-01, ML-03

def test_deep_pages_equal_a_sorted_list(spark, metrics):
    from verdigris.operators.timeseries import deep_page
    tied = metrics.withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.lit(T0)).otherwise(F.col("ts"))).select("event_id", "ts").distinct()
    rows = sorted((tuple(r) for r in tied.collect()), key=lambda r: (r[1] is None, -(r[1] - T0).total_seconds() if r[1] else 0, r[0]))
    for page_no, size in ((1, 10), (30, 100), (29, 103), (3000, 1)):
        got = [tuple(r) for r in deep_page(tied, page_no, size, "ts", "event_id", bins=8, band_rows=50).collect()]
        assert got == rows[(page_no - 1) * size:page_no * size], (page_no, size)


def test_numbered_rows_and_category_indices(spark, metrics):
    from verdigris.functions.ranking import numbered
    from verdigris.operators import features as FE
    got = numbered(metrics, [F.col("co2_kg"), F.col("event_id")])
    rows = got.collect()
    assert sorted(r._pos for r in rows) == list(range(metrics.count()))
    placed = sorted(rows, key=lambda r: r._pos)
    assert [(r.co2_kg is not None, r.co2_kg or 0, r.event_id) for r in placed] == sorted((r.co2_kg is not None, r.co2_kg or 0, r.event_id) for r in rows)
    table = FE.category_table(metrics.withColumn("c", F.concat(F.lit("x"), F.col("event_id") % 700)), ["c", "facility_id"])
    for c in ("c", "facility_id"):
        found = sorted((r["index"], r.category) for r in table.where(F.col("column") == c).collect())
        assert [i for i, _ in found] == list(range(len(found))) and [x for _, x in found] == sorted(x for _, x in found)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


# --- SRC-01

def test_csv_records_over_several_lines(spark, tmp_path):
    from verdigris.sources import files as SF
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text('﻿Source,Timestamp,FacilityID,Energy_kWh\n"two\nlines, and ""quotes""",2024-01-01 00:00:00,"p\n1",5.5\n\nplain,2024-01-02 00:00:00,p2,6\n')
    (tmp_path / "deep" / "b.csv").write_text('FacilityID,Energy_kWh,"No\nte",Timestamp,Source\n7,1.25,"x\n\ny",2024-01-02 00:00:00,solar\n')
    (tmp_path / "deep" / "c.csv").write_text("1,2,3\n4,5,6\n")
    (tmp_path / "deep" / "empty.csv").write_text("")
    (tmp_path / "deep" / "only.csv").write_text("Timestamp,FacilityID,Energy_kWh,Source\n")
    (tmp_path / "deep" / "_hidden.csv").write_text("Timestamp,FacilityID,Energy_kWh,Source\n2024-01-02 00:00:00,h,1,s\n")
    ok, bad = SF.load_historical_csv(spark, str(tmp_path))
    assert sorted((r.facility_id, r.kwh, r.source) for r in ok.collect()) == [
        ("7", 1.25, "solar"), ("p\n1", 5.5, 'two\nlines, and "quotes"'), ("p2", 6.0, "plain")]
    assert [r.file_name for r in bad.collect()] == ["c.csv", "c.csv"]
    catalogue = SF.header_catalogue(spark, str(tmp_path), SF.CSV_SCHEMA.names)
    assert sorted(len(v) for v in catalogue.values()) == [1, 1, 1, 1] and None in catalogue


# --- ML-07 / 09 / 12

def test_no_training_window_overlaps_a_validation_row(metrics):
    from verdigris.operators import forecast as FC
    known = metrics.where("ts is not null and facility_id is not null").dropDuplicates(["event_id"])
    gap, folds = 9, 4
    folded = FC.rolling_origin(known, folds, 0.3, gap, tiebreak="event_id").collect()
    for k in {r.facility_id for r in folded}:
        s = sorted((r for r in folded if r.facility_id == k), key=lambda r: (r.ts, r.event_id))
        for f in range(folds):
            train = [i for i, r in enumerate(s) if r.first_fold is not None and r.first_fold <= f]
            valid = [i for i, r in enumerate(s) if r.fold == f]
            assert valid and train == list(range(len(train))) and min(valid) - max(train) == gap + 1
            assert valid == list(range(valid[0], valid[0] + len(valid)))
        assert sum(r.fold is not None for r in s) == len(s) - math.floor(len(s) * 0.7 + 1e-9)


def test_tuning_prefers_the_true_model(spark):
    from verdigris.operators import forecast as FC
    r = random.Random(6)
    rows = [(k, T0 + dt.timedelta(hours=i), x, 3.0 * x + r.gauss(0, 0.1)) for k in range(3) for i in range(120) for x in [r.random()]]
    df = spark.createDataFrame(rows, "facility_id long, ts timestamp_ntz, x double, y double")
    tuned = FC.tune(df, ["x"], "y", 2, grid=[{"regParam": 0.0}, {"regParam": 5.0}], gap=2)
    assert tuned.best == 0 and tuned.validationMetrics[0] < 0.15 < tuned.validationMetrics[1]
    assert abs(FC.linear_coefficients(tuned.bestModel)[1][0] - 3.0) < 0.1


def test_refreshed_forecast_equals_a_plain_recursion(spark):
    from verdigris.operators import forecast as FC
    r = random.Random(7)
    series = {"a": [r.random() * 9 for _ in range(30)], "b": [1.0, 2.0], "c": [5.0]}
    rows = [(k, T0 + dt.timedelta(hours=i), v) for k, s in series.items() for i, v in enumerate(s)] + [("a", None, 4.0), ("b", T0 + dt.timedelta(hours=9), None), ("d", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    coefs = {"lag_1": 0.5, "lag_4": 0.1, "mean_3": 0.2, "mean_6": 0.1, "hour_sin": 1.0, "hour_cos": 2.0, "day_of_week": 0.3}
    got = {(x.k, x.step): (x.forecast, x.forecast_ts) for x in FC.refreshed_forecast(df, "v", 1.0, coefs, 7, "k").collect()}
    assert len(got) == 21
    for k, s in series.items():
        s, t = [s[0]] * 6 + s, T0 + dt.timedelta(hours=len(s) - 1)
        for step in range(1, 8):
            t += dt.timedelta(hours=1)
            angle = 2 * math.pi * t.hour / 24
            p = (1.0 + 0.5 * s[-1] + 0.1 * s[-4] + 0.2 * sum(s[-3:]) / 3 + 0.1 * sum(s[-6:]) / 6 + math.sin(angle) + 2 * math.cos(angle) + 0.3 * t.weekday())
            s.append(p)
            assert abs(got[k, step][0] - p) < 1e-9 and got[k, step][1] == t
    with pytest.raises(ValueError):
        FC.refreshed_forecast(df, "v", 1.0, {"lagg_1": 1.0}, 2, "k")


@pytest.mark.parametrize("algo", ["linear", "gbt"])
def test_trained_models_beat_the_naive_forecast(spark, algo):
    """An autoregressive series with known noise: the error is near the
    noise, and well below that of the last value as forecast."""
    from verdigris.operators import forecast as FC
    r, rows = random.Random(9), []
    for k in range(4):
        v = 50.0
        for i in range(400):
            v = 50 - 0.7 * (v - 50) + r.gauss(0, 1)
            rows.append((k, T0 + dt.timedelta(hours=i), v))
    df = spark.createDataFrame(rows, "facility_id long, ts timestamp_ntz, co2_kg double")
    feats, cols = FC.forecast_features(df, "co2_kg", lags=(1, 2), means=(3,))
    got = FC.train_forecaster(feats, cols, "co2_kg", algo, max_iter=20)
    m = got["metrics"].first()
    naive = math.sqrt(feats.agg(F.avg((F.col("co2_kg") - F.col("co2_kg_lag_1")) ** 2)).first()[0])
    assert 0.85 < m["rmse"] < (1.15 if algo == "linear" else 1.4) and m["rmse"] < 0.6 * naive and abs(got["sigma"] - m["rmse"]) < 0.1


def test_too_many_categories_for_the_wide_form_raise(spark):
    from verdigris.operators import features as FE
    df = spark.range(30).select(F.col("id").cast("string").alias("c"))
    assert len(FE.fit_categories(df, ["c"], 30)["c"]) == 30
    with pytest.raises(ValueError, match="category_table"):
        FE.fit_categories(df, ["c"], 29)


# --- streams

def test_idle_meters_give_their_state_back(spark, tmp_path):
    from verdigris.streaming import ingest as S
    path, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def add(rows):
        df = spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), float(v)) for k, h, v in rows], "meter string, ts timestamp_ntz, kwh double")
        df.coalesce(1).write.mode("append").parquet(path)
        s = S.read_stream(spark, path, df.schema, "parquet", max_files_per_trigger=1)
        S.run_available_now(S.last_n_readings(s, 3, "meter", idle="10 hours", delay="1 hour"), ckpt, mode="update",
                            foreach_batch=S.idempotent_parquet_sink(out), rocksdb=True)
        got = spark.read.parquet(out)
        last = got.groupBy("meter").agg(F.max("batch_id").alias("batch_id"))
        return {m: sorted(r.kwh for r in got.join(last, ["meter", "batch_id"]).where(F.col("meter") == m).collect()) for m in ("s-1", "s-2")}

    assert add([("s-1", 0, 1), ("s-1", 1, 2), ("s-1", 2, 3), ("s-1", 3, 4), ("s-2", 3, 9)]) == {"s-1": [2, 3, 4], "s-2": [9]}
    assert add([("s-1", 4, 5), ("s-2", 5, 10)]) == {"s-1": [3, 4, 5], "s-2": [9, 10]}
    add([("s-1", 30, 6)])                                # the watermark passes s-2's newest reading by ten hours
    assert add([("s-1", 31, 7), ("s-2", 31, 11)])["s-2"] == [11]


def test_pulses_of_text_sensors_and_ties(spark, tmp_path):
    from verdigris.streaming import ingest as S
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    run = S.pulse_state_batched(state, out, litres_per_pulse=1.0)

    def at(*rows):
        return spark.createDataFrame([(k, None if s is None else T0 + dt.timedelta(seconds=s)) for k, s in rows], "sensor_id string, ts timestamp_ntz")
    run(at(("s-1", 1), ("s-1", 5), ("s-1", 5), ("s-2", 3), ("s-3", None)), 0)
    run(at(("s-1", 4), ("s-2", 9)), 1)
    run(at(("s-1", 4), ("s-2", 9)), 1)  # replayed
    got = {r.sensor_id: (r.pulses, r.last_ts, r.second_ts) for r in spark.read.parquet(f"{state}/batch_id=1").collect()}
    s = [T0 + dt.timedelta(seconds=i) for i in range(10)]
    assert got == {"s-1": (4, s[5], s[5]), "s-2": (2, s[9], s[3]), "s-3": (1, None, None)}


def test_scoring_marks_rows_without_a_feature(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from verdigris.streaming import ingest as S
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 3.0, 6.0)], "id long, x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(df)
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan"))], "id long, x double")
    got = {r.id: (r.x, r.prediction and round(r.prediction, 6), r.error) for r in S.score_stream(rows, model, ["x"]).collect()}
    assert got[1] == (5.0, 10.0, None) and got[2] == (None, None, "missing feature") and got[3][1:] == (None, "missing feature")


# --- one computation of what a query's passes share

def counted(spark):
    """A column unchanged, and the number of times that one of its values was computed."""
    seen = spark.sparkContext.accumulator(0)

    def through(v):
        seen.add(1)
        return v
    return seen, F.udf(through, "double").asNondeterministic()


@pytest.mark.parametrize(("query", "times"), [("ml07_ml14_train_linear", 1), ("ml08_gbt_early_stopping", 1), ("ml10_ml11_ml15_versioned_registry", 1),
                                              ("ml12_win13_recursive_forecast", 1), ("ml13_ml16_agg17_attributions", 2)])
def test_features_of_a_model_are_computed_once(spark, monkeypatch, query, times):
    """Fit, validation and scoring read stored features; the background sample is drawn before."""
    from verdigris.operators import forecast as FC
    from verdigris.plans.catalog import entries
    (seen, through), made, plain = counted(spark), [], FC.forecast_features

    def features(*a, **kw):
        feats, cols = plain(*a, **kw)
        made.append(feats)
        return feats.withColumn(cols[0], through(cols[0])), cols
    monkeypatch.setattr(FC, "forecast_features", features)
    entries()[query].build(spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1 and 0 < seen.value <= times * made[0].count()


def test_training_computes_the_split_once(spark):
    from verdigris.operators import forecast as FC
    seen, through = counted(spark)
    df = spark.range(200).select((F.col("id") % 4).alias("facility_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
                                 F.sin("id").alias("a"), (2 * F.sin("id") + 1).alias("y"))
    res = FC.train_forecaster(df.withColumn("a", through("a")), ["a"], "y")
    assert res["metrics"].first()["n"] == 40 and seen.value == 200


def test_a_retried_audit_writes_what_was_found_once(spark, monkeypatch):
    from verdigris.operators import tables as TB
    from verdigris.plans.catalog import entries
    (seen, through), plain = counted(spark), TB.audit_trail

    def audit(*a, **kw):
        out = plain(*a, **kw)
        return out.withColumn("changed_by", through(F.col("changed_by").cast("double")).cast("int"))
    monkeypatch.setattr(TB, "audit_trail", audit)
    n = entries()["snk06_audit_values"].build(spark, "/root/testdata/sf0.001").count()
    assert n > 0 and seen.value == n


def test_orders_are_joined_before_texts_are_made(spark):
    from verdigris.plans import cat_tables as CT
    from verdigris.plans import logical as L
    d = "/root/testdata/sf0.001"
    got = CT._stamped(spark, d)
    plan = got.select("record_id", "co2e_kg")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Join")
    want = L.emission_records(spark, d).join(L.record_owners(spark, d), "order_key")
    assert rows_of(got.select(*sorted(want.columns))) == rows_of(want.select(*sorted(want.columns)))


def test_merge_keeps_its_rows_as_parquet(spark, monkeypatch):
    """A checkpoint of all rows of the touched chunks has several times their bytes."""
    from verdigris import session
    from verdigris.operators import tables as TB

    def checkpoint(*a, **kw):
        raise AssertionError("checkpoint of whole rows")
    monkeypatch.setattr(session, "cut_lineage", checkpoint)
    rows = [(f"r{i}", T0 + dt.timedelta(days=i % 3, hours=i), float(i)) for i in range(12)]
    path = TB.scratch_path(spark, "merge-parquet")
    TB.write_chunked(spark.createDataFrame(rows, "record_id string, ts timestamp_ntz, co2_kg double"), path, "1 day")
    TB.merge_into_chunks(path, spark.createDataFrame([("r0", T0, 9.0)], "record_id string, ts timestamp_ntz, co2_kg double"), "record_id")
    assert {r.record_id: r.co2_kg for r in spark.read.parquet(path).collect()} == {r[0]: r[2] for r in rows} | {"r0": 9.0}


def test_merge_joins_only_rows_that_may_be_changed(spark, monkeypatch):
    """Repeated and NULL keys, a row that moves, a new one: as by the definition, without a second copy of the touched
    chunks' rows, and with the session's settings as before."""
    from verdigris.functions import quantiles as Q
    from verdigris.operators import tables as TB
    kept, plain = [], Q.stored
    monkeypatch.setattr(Q, "stored", lambda df, name: kept.append(name) or plain(df, name))
    schema, day = "record_id string, ts timestamp_ntz, v double", dt.timedelta(days=1)
    rows = [(None if i % 9 == 0 else f"r{i % 40}", T0 + day * (i % 5), float(i)) for i in range(90)]
    changed = [("r1", T0 + 7 * day, -1.0), ("r2", T0, -2.0), (None, T0, -3.0), ("new", None, -4.0)]
    path = TB.scratch_path(spark, "merge-may")
    TB.write_chunked(spark.createDataFrame(rows, schema), path, "1 day")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(n) for n in names]
    back = TB.merge_into_chunks(path, spark.createDataFrame(changed, schema), "record_id")
    assert [spark.conf.get(n) for n in names] == before
    assert "merge-changed" in kept and "merge-rows" not in kept
    want = [r for r in rows if r[0] not in {"r1", "r2", "new"}] + changed
    assert rows_of(spark.read.parquet(path).select("record_id", "ts", "v")) == sorted(want, key=repr)
    assert rows_of(back.select("record_id", "ts", "v")) == sorted(
        [r for r in want if r[1] is None or r[1].date() in {(T0 + n * day).date() for n in (0, 1, 2, 7)}], key=repr)


def test_rows_with_keys_are_sifted_before_the_join(spark):
    from verdigris.operators import tables as TB
    table = spark.range(20_000).select(F.when(F.col("id") % 100 > 0, F.concat(F.lit("k"), "id")).alias("key"), "id")
    keys = spark.range(0, 3_000, 7).select(F.when(F.col("id") % 100 > 0, F.concat(F.lit("k"), "id")).alias("key"), "id")
    keys = keys.unionByName(keys.limit(50))
    may = TB.with_may(table, keys, "key").where("_may")
    want = {i for i in range(0, 3_000, 7) if i % 100}
    got = {r.id for r in may.collect()}
    assert want <= got and len(got) < len(want) + 20
    found = TB.rows_with_keys(table, keys, "key")
    assert sorted(r.id for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("Join Inner")  # the sifting is below, so its shuffle is of few rows
    none = TB.rows_with_keys(table, keys.where("false"), "key")
    assert none.count() == 0 and none.columns == table.columns


def test_keys_of_another_type_still_meet(spark):
    """Equal numbers of two widths hash otherwise; the joins find them equal."""
    from verdigris.operators import tables as TB
    wide = spark.range(10).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("v"))
    narrow = wide.where("id < 3").select(F.col("id").cast("int").alias("id"), "ts", F.lit(1).alias("v"))
    assert TB.rows_with_keys(wide, narrow, "id").count() == 3
    path = TB.scratch_path(spark, "merge-types")
    TB.write_chunked(wide, path, "1 day")
    TB.merge_into_chunks(path, narrow, "id")
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(i, int(i < 3)) for i in range(10)]


def test_chunks_of_derived_rows_are_dealt_narrow(spark):
    from verdigris.operators import tables as TB
    df = spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 9000).cast("timestamp_ntz").alias("at"))
    made = lambda x: x.select(F.col("at").alias("ts"), "id", F.repeat(F.col("id").cast("string"), 3).alias("text"), "chunk")
    one, two = (TB.scratch_path(spark, x) for x in ("narrow", "plain"))
    TB.write_chunked(df, one, "7 days", order=["id"], made=made, at="at")
    TB.write_chunked(made(df.withColumn("chunk", F.lit(0))).drop("chunk"), two, "7 days")
    one, two = spark.read.parquet(one), spark.read.parquet(two)
    assert rows_of(one) == rows_of(two) and TB.chunk_width(one) == TB.chunk_width(two) == "7 days"
