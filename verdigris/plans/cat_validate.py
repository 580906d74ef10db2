"""Registered checks: validation rules (VAL-01..17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import validate as V
from verdigris.plans import logical as L
from verdigris.plans.catalog import register
from verdigris.plans.rounding import r, sql_r

AS_OF_REPLAY = "2001-06-30 00:00:00"


def _failed_sql(rules: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN NOT coalesce({p}, false) THEN '{n}' END" for n, p in rules)
    return f"concat_ws(',', {parts})"


CREATE_RULES_SQL = [
    ("co2_kg_non_negative", "co2_kg >= 0"), ("energy_kwh_non_negative", "energy_kwh >= 0"),
    ("water_l_non_negative", "water_l >= 0"), ("ch4_g_non_negative", "coalesce(ch4_g, 0) >= 0"),
    ("n2o_g_non_negative", "coalesce(n2o_g, 0) >= 0"),
    ("source_type_length", "length(source_type) BETWEEN 2 AND 50"),
    ("device_id_length", "length(device_id) BETWEEN 5 AND 50"), ("ts_present", "ts IS NOT NULL"),
    ("timestamp_not_future", f"ts <= TIMESTAMP '{AS_OF_REPLAY}' + INTERVAL 5 MINUTE"),
]


def _create_tagged(spark, d):
    rules = V.emission_create_rules() + [V.not_future(AS_OF_REPLAY)]
    return V.tag_failures(L.emission_records(spark, d), rules), [n for n, _ in rules]


@register("val01_02_emission_rejects", "VAL-01", L.with_ctes(f"""
SELECT record_id, failed FROM (SELECT record_id, {_failed_sql(CREATE_RULES_SQL)} AS failed FROM rc)
WHERE failed <> ''""", rc=L.EMISSION_RECORDS_SQL))
def val01(spark, d):
    t, _ = _create_tagged(spark, d)
    return (t.filter(F.size("failed_rules") > 0)
             .select("record_id", F.concat_ws(",", "failed_rules").alias("failed")))


@register("val02_future_rule_counts", "VAL-02", L.with_ctes(" UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST(count_if(NOT coalesce({p}, false)) AS BIGINT) AS n_failed FROM rc"
    for n, p in CREATE_RULES_SQL), rc=L.EMISSION_RECORDS_SQL))
def val02(spark, d):
    t, names = _create_tagged(spark, d)
    return V.failure_counts(t, names)


def _update_payloads(spark, d):
    e = L.table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("payload_id"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("co2_kg"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("energy_kwh"),
        F.when(F.col("event_type") == "error", -F.col("value")).alias("water_l"),
        F.repeat("props", F.floor("value").cast("int")).alias("notes"))


UPDATE_PAYLOADS_SQL = """
SELECT event_id AS payload_id,
       CASE WHEN event_type = 'click' THEN value END AS co2_kg,
       CASE WHEN event_type = 'view' THEN value END AS energy_kwh,
       CASE WHEN event_type = 'error' THEN -value END AS water_l,
       repeat(props, CAST(floor(value) AS INTEGER)) AS notes
FROM events"""

UPDATE_RULES_SQL = [
    ("co2_kg_non_negative", "co2_kg IS NULL OR co2_kg >= 0"),
    ("energy_kwh_non_negative", "energy_kwh IS NULL OR energy_kwh >= 0"),
    ("water_l_non_negative", "water_l IS NULL OR water_l >= 0"),
    ("notes_length", "notes IS NULL OR length(notes) BETWEEN 0 AND 500"),
]


@register("val03_update_payload_rejects", "VAL-03", L.with_ctes(f"""
SELECT payload_id, failed FROM (SELECT payload_id, {_failed_sql(UPDATE_RULES_SQL)} AS failed FROM up)
WHERE failed <> ''""", up=UPDATE_PAYLOADS_SQL))
def val03(spark, d):
    _, rej = V.split_valid(_update_payloads(spark, d), V.emission_update_rules())
    return rej.select("payload_id", F.concat_ws(",", "failed_rules").alias("failed"))


# Fixed values of this fixture: part type -> declared material (mixed case and
# one unknown material on purpose).
def _material(c):
    return (F.when(c == "STANDARD", "steel").when(c == "ECONOMY", "Plastic")
             .when(c == "PROMO", "ALUMINUM").when(c == "LARGE", "concrete")
             .when(c == "SMALL", "wood").otherwise("x"))


MATERIAL_SQL = ("CASE p_type WHEN 'STANDARD' THEN 'steel' WHEN 'ECONOMY' THEN 'Plastic' "
                "WHEN 'PROMO' THEN 'ALUMINUM' WHEN 'LARGE' THEN 'concrete' WHEN 'SMALL' THEN 'wood' "
                "ELSE 'x' END")


def _prediction_inputs(spark, d):
    p = L.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("input_id"),
        F.col("p_retailprice").alias("energy_usage"),
        (F.col("p_size") - 5).cast("double").alias("water_usage"),
        (F.col("p_size") - 3).alias("machines_active"),
        _material(F.col("p_type")).alias("material_type"),
        ((F.col("p_size") - 1) / 2).alias("duration_hours"),
        (F.col("p_size") / 40).alias("efficiency_gain"),
        ((F.col("p_retailprice") - 905) / 90).alias("renewable_ratio"))


PREDICTION_INPUTS_SQL = f"""
SELECT p_partkey AS input_id, p_retailprice AS energy_usage, CAST(p_size - 5 AS DOUBLE) AS water_usage,
       p_size - 3 AS machines_active, {MATERIAL_SQL} AS material_type,
       (p_size - 1) / 2 AS duration_hours, p_size / 40 AS efficiency_gain,
       (p_retailprice - 905) / 90 AS renewable_ratio
FROM part"""

PRED_RULES_SQL = [
    ("energy_usage_non_negative", "energy_usage >= 0"), ("water_usage_non_negative", "water_usage >= 0"),
    ("machines_active_non_negative", "machines_active >= 0"), ("duration_positive", "duration_hours > 0"),
    ("material_length", "length(material_type) >= 2"),
    ("material_allowed", "lower(material_type) IN ('steel', 'plastic', 'aluminum', 'concrete')"),
]
SCEN_RULES_SQL = PRED_RULES_SQL + [
    ("efficiency_in_unit", "efficiency_gain BETWEEN 0 AND 1"),
    ("renewable_in_unit", "renewable_ratio BETWEEN 0 AND 1")]


@register("val04_prediction_inputs", "VAL-04", L.with_ctes(f"""
SELECT input_id, lower(material_type) AS material_type, {_failed_sql(PRED_RULES_SQL)} AS failed FROM pi""",
    pi=PREDICTION_INPUTS_SQL))
def val04(spark, d):
    t = V.tag_failures(_prediction_inputs(spark, d), V.prediction_input_rules())
    return V.normalise_material(t).select("input_id", "material_type",
                                          F.concat_ws(",", "failed_rules").alias("failed"))


@register("val05_scenario_inputs", "VAL-05", L.with_ctes(f"""
SELECT input_id, {_failed_sql(SCEN_RULES_SQL)} AS failed FROM pi""", pi=PREDICTION_INPUTS_SQL))
def val05(spark, d):
    t = V.tag_failures(_prediction_inputs(spark, d), V.scenario_rules())
    return t.select("input_id", F.concat_ws(",", "failed_rules").alias("failed"))


@register("val06_missing_share", "VAL-06", L.with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sql_r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_share, "
    f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) <= 0.05 AS passed FROM sf"
    for c in ("ts", "value", "error")), sf=L.SENSOR_FEED_SQL))
def val06(spark, d):
    out = V.missing_share(L.sensor_feed(spark, d), ["ts", "value", "error"], 0.05)
    return out.select("column", r("missing_share").alias("missing_share"), "passed")


@register("val07_range_check", "VAL-07", L.with_ctes("""
SELECT 'co2_kg' AS "column", coalesce(bool_and(coalesce(co2_kg BETWEEN 0 AND 400, false)), true) AS passed FROM em
UNION ALL
SELECT 'anomaly_score', coalesce(bool_and(coalesce(anomaly_score BETWEEN 0 AND 1, false)), true) FROM em""",
    em=L.EMISSION_METRICS_SQL))
def val07(spark, d):
    return V.range_check(L.emission_metrics(spark, d), {"co2_kg": (0, 400), "anomaly_score": (0, 1)})


_SPARK_TYPES = "CASE WHEN t LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE lower(t) END"


@register("val08_dtype_check", "VAL-08", L.with_ctes(f"""
SELECT c AS "column", e AS expected, {_SPARK_TYPES} AS actual, {_SPARK_TYPES} = e AS passed, n AS n_values FROM (
  SELECT 'ts' AS c, 'timestamp_ntz' AS e, typeof(any_value(ts)) AS t, count(ts) AS n FROM em
  UNION ALL SELECT 'facility_id', 'bigint', typeof(any_value(facility_id)), count(facility_id) FROM em
  UNION ALL SELECT 'co2_kg', 'double', typeof(any_value(co2_kg)), count(co2_kg) FROM em
  UNION ALL SELECT 'anomaly_score', 'float', typeof(any_value(anomaly_score)), count(anomaly_score) FROM em)""",
    em=L.EMISSION_METRICS_SQL))
def val08(spark, d):
    return V.dtype_check(L.emission_metrics(spark, d),
                         {"ts": "timestamp_ntz", "facility_id": "bigint", "co2_kg": "double",
                          "anomaly_score": "float"})


HOURLY_SQL = "SELECT DISTINCT facility_id, date_trunc('hour', ts) AS ts FROM eu"


def _hourly(spark, d):
    eu = L.energy_usage(spark, d)
    return eu.select("facility_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).distinct()


@register("val09_step_mode", "VAL-09", L.with_ctes("""
SELECT us / 1000000 AS step_seconds, count(*) AS step_count, us / 1000000 = 3600.0 AS passed FROM (
  SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY facility_id ORDER BY ts) AS us FROM h)
WHERE us IS NOT NULL GROUP BY us ORDER BY count(*) DESC, us ASC LIMIT 1""", eu=L.ENERGY_USAGE_SQL, h=HOURLY_SQL))
def val09(spark, d):
    return V.step_check(_hourly(spark, d), 3600.0, keys=["facility_id"])


@register("val09_step_mode_global", "VAL-09", L.with_ctes("""
SELECT us / 1000000 AS step_seconds, count(*) AS step_count FROM (
  SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS us FROM em)
WHERE us IS NOT NULL GROUP BY us ORDER BY count(*) DESC, us ASC LIMIT 1""", em=L.EMISSION_METRICS_SQL))
def val09g(spark, d):
    return V.step_mode(L.emission_metrics(spark, d))


@register("val10_overall_verdict", "VAL-10", L.with_ctes("""
SELECT m.missing_ok, r.ranges_ok, t.dtypes_ok, st.steps_ok,
       m.missing_ok AND r.ranges_ok AND t.dtypes_ok AND st.steps_ok AS valid
FROM (SELECT bool_and(share <= 0.05) AS missing_ok FROM (
        SELECT avg(CASE WHEN ts IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM sf
        UNION ALL SELECT avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) FROM sf)) m,
     (SELECT coalesce(bool_and(coalesce(co2_kg BETWEEN 0 AND 500, false)), true) AS ranges_ok FROM em) r,
     (SELECT bool_and(typeof(co2_kg) = 'DOUBLE') AS dtypes_ok FROM (SELECT co2_kg FROM em LIMIT 1)) t,
     (SELECT coalesce(bool_and(us / 1000000 = 3600.0), false) AS steps_ok FROM (
        SELECT us FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY facility_id ORDER BY ts) AS us FROM h)
        WHERE us IS NOT NULL GROUP BY us ORDER BY count(*) DESC, us ASC LIMIT 1)) st""",
    sf=L.SENSOR_FEED_SQL, em=L.EMISSION_METRICS_SQL, eu=L.ENERGY_USAGE_SQL, h=HOURLY_SQL))
def val10(spark, d):
    sf = L.sensor_feed(spark, d)
    em = L.emission_metrics(spark, d)
    return V.overall_verdict(
        V.missing_share(sf, ["ts", "value"]), V.range_check(em, {"co2_kg": (0, 500)}),
        V.dtype_check(em, {"co2_kg": "double"}), V.step_check(_hourly(spark, d), 3600.0, keys=["facility_id"]))


SENSOR_RULES_SQL = [("energy_in_range", "value BETWEEN 0 AND 10000"),
                    ("source_allowed", "kind IN ('click', 'view', 'purchase')")]


@register("val11_sensor_bounds", "VAL-11", L.with_ctes(f"""
SELECT reading_id, failed FROM (SELECT reading_id, {_failed_sql(SENSOR_RULES_SQL)} AS failed FROM sf)
WHERE failed <> ''""", sf=L.SENSOR_FEED_SQL))
def val11(spark, d):
    rules = V.sensor_bounds_rules(0, 10000, ("click", "view", "purchase"), energy="value", source="kind")
    _, rej = V.split_valid(L.sensor_feed(spark, d), rules)
    return rej.select("reading_id", F.concat_ws(",", "failed_rules").alias("failed"))


@register("val12_negative_meter_deltas", "VAL-12", L.with_ctes("""
SELECT reading_id, ts, sensor_id, delta_kwh FROM (
  SELECT reading_id, ts, sensor_id,
         value - lag(value) OVER (PARTITION BY sensor_id ORDER BY ts, reading_id) AS delta_kwh
  FROM sf WHERE value IS NOT NULL) WHERE delta_kwh < 0""", sf=L.SENSOR_FEED_SQL))
def val12(spark, d):
    from verdigris.operators.features import meter_deltas
    sf = L.sensor_feed(spark, d).filter(F.col("value").isNotNull())
    deltas = meter_deltas(sf, "value", key="sensor_id", tiebreak="reading_id", out="delta_kwh")
    _, rej = V.split_valid(deltas.filter(F.col("delta_kwh").isNotNull()), V.non_negative("delta_kwh"))
    return rej.select("reading_id", "ts", "sensor_id", "delta_kwh")


RAW_READINGS_SQL = """
SELECT event_id AS row_id,
       '2023-10-10T' || printf('%02d', event_id) || ':00:00Z' AS "timestamp",
       CASE WHEN event_type = 'error' THEN 'not-a-number' ELSE CAST(value AS VARCHAR) END AS kwh
FROM events"""


def _raw_readings(spark, d):
    e = L.table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("2023-10-10T"), F.format_string("%02d", "event_id"), F.lit(":00:00Z")).alias("timestamp"),
        F.when(F.col("event_type") == "error", F.lit("not-a-number"))
         .otherwise(F.col("value").cast("string")).alias("kwh"))


@register("val13_malformed_readings", "VAL-13", L.with_ctes("""
SELECT row_id, try_strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ') AS ts_parsed,
       TRY_CAST(kwh AS DOUBLE) AS kwh_parsed
FROM raw WHERE try_strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL AND TRY_CAST(kwh AS DOUBLE) IS NOT NULL""",
    raw=RAW_READINGS_SQL))
def val13(spark, d):
    parsed = V.parse_raw_reading(_raw_readings(spark, d))
    valid, _ = V.split_valid(parsed, V.malformed_rules())
    return valid.select("row_id", "ts_parsed", "kwh_parsed")


@register("val13_reject_counts", "VAL-13", L.with_ctes("""
SELECT count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected FROM (
  SELECT try_strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL AND TRY_CAST(kwh AS DOUBLE) IS NOT NULL AS ok
  FROM raw)""", raw=RAW_READINGS_SQL))
def val13c(spark, d):
    parsed = V.tag_failures(V.parse_raw_reading(_raw_readings(spark, d)), V.malformed_rules())
    ok = F.size("failed_rules") == 0
    return parsed.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


@register("val14_required_columns", "VAL-14", L.with_ctes("""
SELECT reading_id, 'value_present' AS failed FROM sf WHERE value IS NULL""", sf=L.SENSOR_FEED_SQL))
def val14(spark, d):
    _, rej = V.split_valid(L.sensor_feed(spark, d), V.required_present(["ts", "sensor_id", "value"]))
    return rej.select("reading_id", F.concat_ws(",", "failed_rules").alias("failed"))


@register("val15_orphan_usage", "VAL-15", L.with_ctes("""
SELECT ts, facility_id FROM eu WHERE facility_id NOT IN (SELECT facility_id FROM fac)""",
    eu=L.ENERGY_USAGE_SQL, fac=L.FACILITIES_SQL))
def val15(spark, d):
    o = V.orphans(L.energy_usage(spark, d), L.facilities(spark, d), "facility_id", "facility_id")
    return o.select("ts", "facility_id")


TRANSFERS_SQL = """
SELECT c_custkey AS request_id, '0x' || lpad(hex(c_custkey * 1000003), 40, '0') AS recipient,
       c_acctbal AS amount, c_name AS note
FROM customer"""
TRANSFER_RULES_SQL = [("recipient_length", "length(recipient) = 42"),
                      ("recipient_format", "regexp_full_match(recipient, '0x[0-9a-fA-F]{40}')"),
                      ("amount_positive", "amount > 0"),
                      ("note_length", "note IS NULL OR length(note) BETWEEN 0 AND 500")]


@register("val16_transfer_requests", "VAL-16", L.with_ctes(f"""
SELECT request_id, failed FROM (SELECT request_id, {_failed_sql(TRANSFER_RULES_SQL)} AS failed FROM tr)
WHERE failed <> ''""", tr=TRANSFERS_SQL))
def val16(spark, d):
    c = L.table(spark, d, "customer")
    tr = c.select(F.col("c_custkey").alias("request_id"),
                  F.concat(F.lit("0x"), F.lpad(F.hex(F.col("c_custkey") * 1000003), 40, "0")).alias("recipient"),
                  F.col("c_acctbal").alias("amount"), F.col("c_name").alias("note"))
    _, rej = V.split_valid(tr, V.transfer_rules())
    return rej.select("request_id", F.concat_ws(",", "failed_rules").alias("failed"))


@register("val17_batch_cap", "VAL-17", L.with_ctes("""
SELECT batch, count(*) AS n_rows, count(*) <= 1000 AS accepted FROM (
  SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS batch FROM rc) GROUP BY batch""", rc=L.EMISSION_RECORDS_SQL))
def val17(spark, d):
    rc = L.emission_records(spark, d).withColumn("batch", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    ok, bad = V.batch_cap(rc, "batch", 1000)
    a = ok.groupBy("batch").agg(F.count("*").alias("n_rows")).withColumn("accepted", F.lit(True))
    b = bad.groupBy("batch").agg(F.count("*").alias("n_rows")).withColumn("accepted", F.lit(False))
    return a.unionByName(b)
