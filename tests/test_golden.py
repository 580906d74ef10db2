"""Golden values from the reference's own tests (cleaning, ledger, what-if)."""

import datetime as dt

from pyspark.sql import functions as F

from verdigris.operators import anomaly, carbon, features, ledger, validate


def _series(spark):
    # [10, 12, 14, 1000, 15, null, 16], hourly positions
    vals = [10.0, 12.0, 14.0, 1000.0, 15.0, None, 16.0]
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i), v) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "pos int, ts timestamp_ntz, value double")


def test_iqr_drop_golden(spark):
    df = _series(spark)
    b = anomaly.iqr_bounds(df, "value").first()
    assert (b.q1, b.q3) == (12.5, 15.75)
    assert abs(b.lower - 7.625) < 1e-12 and abs(b.upper - 20.625) < 1e-12
    kept = sorted(r.value for r in anomaly.iqr_filter(df, "value").collect())
    assert kept == [10.0, 12.0, 14.0, 15.0, 16.0]


def test_time_linear_interpolation_golden(spark):
    out = features.interpolate_linear(_series(spark), "value").orderBy("pos").collect()
    vals = [r.value for r in out]
    assert None not in vals
    assert vals[4:7] == [15.0, 15.5, 16.0]


def test_interpolation_keeps_ends_missing(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0, None), (t0 + dt.timedelta(hours=1), 1.0),
                                (t0 + dt.timedelta(hours=3), 3.0), (t0 + dt.timedelta(hours=4), None)],
                               "ts timestamp_ntz, value double")
    vals = [r.value for r in features.interpolate_linear(df, "value").orderBy("ts").collect()]
    assert vals == [None, 1.0, 3.0, None]


def _ledger(spark):
    from decimal import Decimal
    wei = Decimal(10 ** 18)
    rows = [(1, 1, "mint", None, 1, 100, 1000 * wei), (2, 2, "transfer", 1, 2, 1, 500 * wei)]
    return spark.createDataFrame(rows, "seq long, block long, kind string, from_acct long, to_acct long, "
                                       "operator long, amount_wei decimal(38,0)")


def test_ledger_balances_golden(spark):
    ev = _ledger(spark)
    bal = {r.account: r.balance_wei for r in ledger.balances(ev).collect()}
    assert bal == {1: 500 * 10 ** 18, 2: 500 * 10 ** 18}
    assert ledger.total_supply(ev).first().total_supply_wei == 1000 * 10 ** 18


def test_mint_by_non_minter_refused(spark):
    ev = _ledger(spark)
    grants = spark.createDataFrame([(100, "minter")], "account long, role string")
    ok, refused = ledger.mint_authority(ev, grants)
    assert ok.count() == 1 and refused.count() == 0
    ok2, refused2 = ledger.mint_authority(ev, spark.createDataFrame([(7, "minter")], "account long, role string"))
    assert ok2.count() == 0 and refused2.count() == 1


def test_overdraft_flags_first_negative_event(spark):
    from decimal import Decimal
    wei = Decimal(10 ** 18)
    rows = [(1, 1, "mint", None, 1, 1, 10 * wei), (2, 2, "transfer", 1, 2, 1, 8 * wei),
            (3, 3, "burn", 1, None, 1, 5 * wei), (4, 4, "burn", 1, None, 1, 1 * wei)]
    ev = spark.createDataFrame(rows, "seq long, block long, kind string, from_acct long, to_acct long, "
                                     "operator long, amount_wei decimal(38,0)")
    out = ledger.overdraft_screen(ev).collect()
    assert [(r.account, r.seq) for r in out] == [(1, 3)]


def test_scenario_golden(spark):
    base = spark.createDataFrame([("steel", 1500.0, 200.0)], "material string, energy_usage double, water_usage double")
    sc = spark.createDataFrame([("mix", 0.15, 0.4)], "name string, efficiency double, renewable double")
    out = {r.scenario: r for r in carbon.scenario_analysis(base, sc).collect()}
    assert abs(out["mix"].energy_usage - 1122.0) < 1e-9
    assert abs(out["mix"].water_usage - 170.0) < 1e-9
    assert out["base"].energy_usage == 1500.0


def test_sensor_boundary_validation(spark):
    df = spark.createDataFrame([(5000.0, "solar"), (-50.0, "invalid")], "energy double, source string")
    ok, bad = validate.split_valid(df, validate.sensor_bounds_rules(0, 10000, ["solar", "grid"]))
    assert [r.energy for r in ok.collect()] == [5000.0]
    assert bad.first().failed_rules == ["energy_in_range", "source_allowed"]


def test_large_batch_only_valid_hours_parse(spark):
    # 1,000,000 rows, timestamps 2023-10-10T{h:02}:00:00Z, only h <= 23 parse
    raw = spark.range(1_000_000).select(
        F.concat(F.lit("2023-10-10T"), F.format_string("%02d", "id"), F.lit(":00:00Z")).alias("timestamp"),
        (F.col("id") * 10).cast("string").alias("kwh"))
    tagged = validate.tag_failures(validate.parse_raw_reading(raw), validate.malformed_rules())
    counts = tagged.agg(F.count_if(F.size("failed_rules") == 0).alias("ok"),
                        F.count_if(F.size("failed_rules") > 0).alias("bad")).first()
    assert (counts.ok, counts.bad) == (24, 999_976)


def test_malformed_and_future_and_negative(spark):
    raw = spark.createDataFrame([("invalid-date", "not-a-number"), ("2023-10-10T01:00:00Z", "150.25")],
                                "timestamp string, kwh string")
    ok, bad = validate.split_valid(validate.parse_raw_reading(raw), validate.malformed_rules())
    assert ok.count() == 1 and bad.first().failed_rules == ["timestamp_parses", "kwh_numeric"]
    now = dt.datetime(2024, 1, 1, 12, 0)
    df = spark.createDataFrame([(now + dt.timedelta(days=1), 150.0), (now + dt.timedelta(minutes=4), 150.0)],
                               "ts timestamp_ntz, kwh double")
    ok, bad = validate.split_valid(df, [validate.not_future(now)])
    assert ok.count() == 1 and bad.count() == 1
    neg = spark.createDataFrame([(-50.0,)], "kwh double")
    assert validate.split_valid(neg, validate.non_negative("kwh"))[1].count() == 1


def test_hourly_totals_five_buckets(spark):
    # F8: 5 rows, now - i hours, kwh 100 (i + 1)
    from verdigris.operators.timeseries import bucket_totals
    now = dt.datetime(2024, 1, 1, 12, 30)
    rows = [(now - dt.timedelta(hours=i), "1", 100.0 * (i + 1), "grid") for i in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, facility_id string, kwh double, source string")
    out = sorted(r.total for r in bucket_totals(df, "kwh", "1 hour").collect())
    assert out == [100.0, 200.0, 300.0, 400.0, 500.0]


def test_overdraft_screen_flags_the_first_overdraft(spark):
    from decimal import Decimal
    w = Decimal(10 ** 18)
    rows = [(1, 1, "mint", None, 1, 1, 10 * w), (2, 2, "transfer", 1, 2, 1, 15 * w),
            (3, 3, "transfer", 2, 3, 2, 5 * w), (4, 4, "transfer", 1, 3, 1, 4 * w)]
    ev = spark.createDataFrame(rows, "seq long, block long, kind string, from_acct long, to_acct long, "
                                     "operator long, amount_wei decimal(38,0)")
    assert [r.seq for r in ledger.overdraft_screen(ev).collect()] == [2]


def test_multi_format_timestamps_zone_free(spark):
    from verdigris.functions.time import parse_timestamp
    rows = [("2024-01-05 15:04:00",), ("2024-01-05T15:04:00Z",), ("1/5/2024 3:04 PM",), ("01/05/2024 03:04 PM",),
            ("2024-03-10 02:30:00",), ("not a date",), ("2024-01-05 25:00:00",)]
    df = spark.createDataFrame(rows, "raw string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")   # 02:30 on 2024-03-10 is a DST gap
        got = [r.ts for r in df.select(parse_timestamp("raw").alias("ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    want = dt.datetime(2024, 1, 5, 15, 4)
    assert got[:4] == [want] * 4
    assert got[4] == dt.datetime(2024, 3, 10, 2, 30)
    assert got[5] is None and got[6] is None
