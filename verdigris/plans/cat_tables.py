"""Registered checks: table maintenance (SNK-01..13, JOIN-07, FLT-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.quantiles import stored
from verdigris.operators import tables as TB
from verdigris.operators.timeseries import active_rows
from verdigris.plans import logical as L
from verdigris.plans.catalog import register
from verdigris.plans.cat_timeseries import RECORDS_CO2E_SQL
from verdigris.plans.rounding import r, sql_r

AS_OF = "2024-06-01 00:00:00"


def _staged(spark, d):
    o = L.table(spark, d, "orders")
    return o.select(F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("facility_id"),
                    F.col("o_totalprice").alias("kwh"), F.col("o_orderpriority").alias("source"),
                    F.col("o_orderkey").alias("row_no"), F.col("o_orderstatus").alias("status"))


STAGED_SQL = """
SELECT o_orderdate AS ts, o_custkey AS facility_id, o_totalprice AS kwh, o_orderpriority AS source,
       o_orderkey AS row_no, o_orderstatus AS status FROM orders"""


@register("snk01_join07_insert_ignore", "SNK-01", L.with_ctes("""
SELECT ts, facility_id, kwh, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY ts, facility_id ORDER BY row_no) AS rn FROM st) f
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM st t WHERE t.status = 'F' AND t.ts = f.ts AND t.facility_id = f.facility_id)""",
    st=STAGED_SQL))
def snk01(spark, d):
    st = _staged(spark, d)
    target = st.filter(F.col("status") == "F")
    return TB.insert_ignore(target, st, ["ts", "facility_id"], ["row_no"]).select("ts", "facility_id", "kwh", "row_no")


def _stamped(spark, d):
    return TB.stamp_new_records(L.owned_records(spark, d), F.col("created_by"), AS_OF)


STAMPED_SQL = f"""
SELECT rc.*, o_custkey AS created_by, TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at,
       1 AS version, CAST(NULL AS TIMESTAMP) AS deleted_at
FROM ({RECORDS_CO2E_SQL}) rc JOIN orders ON order_key = o_orderkey"""


@register("snk02_bulk_append_stamps", "SNK-02", L.with_ctes(f"""
SELECT record_id, {sql_r('co2e_kg')} AS co2e_kg, created_by, created_at, updated_at, version FROM sr""",
    sr=STAMPED_SQL))
def snk02(spark, d):
    return _stamped(spark, d).select("record_id", r("co2e_kg").alias("co2e_kg"), "created_by", "created_at",
                                     "updated_at", "version")


@register("snk03_single_create", "SNK-03", L.with_ctes(f"""
SELECT record_id, {sql_r('co2e_kg')} AS co2e_kg, 99 AS created_by, TIMESTAMP '{AS_OF}' AS created_at
FROM rc ORDER BY ts DESC, record_id LIMIT 1""", rc=RECORDS_CO2E_SQL))
def snk03(spark, d):
    one = L.emission_records(spark, d).orderBy(F.desc("ts"), "record_id").limit(1)
    out = TB.stamp_new_records(one, 99, AS_OF)
    return out.select("record_id", r("co2e_kg").alias("co2e_kg"), "created_by", "created_at")


def _updates(spark, d):
    rc = L.emission_records(spark, d).filter(F.col("source_type") == "RF")
    return rc.select("record_id", (F.col("co2_kg") * 0.9).alias("co2_kg"),
                     F.lit(None).cast("double").alias("energy_kwh"), F.col("energy_kwh").alias("water_l"))


UPDATES_SQL = """SELECT record_id, co2_kg * 0.9 AS co2_kg, CAST(NULL AS DOUBLE) AS energy_kwh, energy_kwh AS water_l
FROM rc WHERE source_type = 'RF'"""
UPDATE_AT = "2024-07-01 00:00:00"


def _update_sql(admin: bool, user: int):
    allow = "u.record_id IS NOT NULL" + ("" if admin else f" AND s.created_by = {user}")
    return L.with_ctes(f"""
SELECT s.record_id, {sql_r(f'CASE WHEN {allow} THEN coalesce(u.co2_kg, s.co2_kg) ELSE s.co2_kg END')} AS co2_kg,
       CASE WHEN {allow} THEN coalesce(u.water_l, s.water_l) ELSE s.water_l END AS water_l,
       CASE WHEN {allow} THEN s.version + 1 ELSE s.version END AS version,
       CASE WHEN {allow} THEN TIMESTAMP '{UPDATE_AT}' ELSE s.updated_at END AS updated_at
FROM sr s LEFT JOIN up u USING (record_id)""", rc=L.EMISSION_RECORDS_SQL, sr=STAMPED_SQL, up=UPDATES_SQL)


@register("snk04_partial_update_owner", "SNK-04", _update_sql(False, 7))
def snk04(spark, d):
    out = TB.apply_updates(_stamped(spark, d), _updates(spark, d), user_id=7, is_admin=False, as_of=UPDATE_AT)
    return out.select("record_id", r("co2_kg").alias("co2_kg"), "water_l", "version", "updated_at")


@register("snk04_partial_update_admin", "SNK-04", _update_sql(True, 7))
def snk04a(spark, d):
    out = TB.apply_updates(_stamped(spark, d), _updates(spark, d), user_id=7, is_admin=True, as_of=UPDATE_AT)
    return out.select("record_id", r("co2_kg").alias("co2_kg"), "water_l", "version", "updated_at")


DELETE_AT = "2024-08-01 00:00:00"
DELETE_KEYS_SQL = "SELECT record_id FROM rc WHERE source_type = 'AF' AND ts < TIMESTAMP '1996-01-01 00:00:00'"


def _delete_keys(spark, d):
    rc = L.emission_records(spark, d)
    return rc.filter((F.col("source_type") == "AF") & (F.col("ts") < F.lit("1996-01-01").cast("timestamp_ntz")))


@register("snk05_flt06_soft_delete", "SNK-05", L.with_ctes(f"""
SELECT s.record_id, CASE WHEN k.record_id IS NOT NULL THEN TIMESTAMP '{DELETE_AT}' END AS deleted_at
FROM sr s LEFT JOIN dk k USING (record_id)""",
    rc=L.EMISSION_RECORDS_SQL, sr=STAMPED_SQL, dk=DELETE_KEYS_SQL))
def snk05(spark, d):
    t = TB.soft_delete(_stamped(spark, d), _delete_keys(spark, d), is_admin=True, as_of=DELETE_AT)
    return active_rows(t, include_deleted=True).select("record_id", "deleted_at")


@register("flt06_active_rows", "FLT-06", L.with_ctes("""
SELECT s.record_id FROM sr s LEFT JOIN dk k USING (record_id) WHERE k.record_id IS NULL""",
    rc=L.EMISSION_RECORDS_SQL, sr=STAMPED_SQL, dk=DELETE_KEYS_SQL))
def flt06(spark, d):
    t = TB.soft_delete(_stamped(spark, d), _delete_keys(spark, d), is_admin=True, as_of=DELETE_AT)
    return active_rows(t, include_deleted=False).select("record_id")


@register("snk06_audit_trail", "SNK-06", L.with_ctes(f"""
SELECT coalesce(o.record_id, n.record_id) AS record_id,
       CASE WHEN o.record_id IS NULL THEN 'C' WHEN n.record_id IS NULL THEN 'D'
            WHEN k.record_id IS NOT NULL THEN 'D' ELSE 'U' END AS operation_type
FROM (SELECT * FROM sr WHERE ts < TIMESTAMP '2001-10-01 00:00:00') o
FULL JOIN (SELECT record_id FROM sr WHERE ts >= TIMESTAMP '1995-02-01 00:00:00') n USING (record_id)
LEFT JOIN dk k ON k.record_id = coalesce(o.record_id, n.record_id)
LEFT JOIN up u ON u.record_id = coalesce(o.record_id, n.record_id)
WHERE o.record_id IS NULL OR n.record_id IS NULL OR k.record_id IS NOT NULL
   OR (u.record_id IS NOT NULL AND (u.co2_kg IS NOT NULL OR u.water_l IS NOT NULL))""",
    rc=L.EMISSION_RECORDS_SQL, sr=STAMPED_SQL, dk=DELETE_KEYS_SQL, up=UPDATES_SQL))
def snk06(spark, d):
    st = _stamped(spark, d)
    old = st.filter(F.col("ts") < F.lit("2001-10-01").cast("timestamp_ntz"))
    new = st.filter(F.col("ts") >= F.lit("1995-02-01").cast("timestamp_ntz"))
    new = TB.apply_updates(new, _updates(spark, d), user_id=0, is_admin=True, as_of=UPDATE_AT)
    new = TB.soft_delete(new, _delete_keys(spark, d), is_admin=True, as_of=DELETE_AT)
    cols = ["co2_kg", "energy_kwh", "water_l", "deleted_at"]
    a = TB.audit_trail(old, new, "record_id", cols, changed_by=0, as_of=DELETE_AT)
    return a.select("record_id", "operation_type")


@register("snk07_time_chunked_layout", "SNK-07", L.with_ctes("""
SELECT CAST(ts AS DATE) AS chunk, count(*) AS n FROM eu GROUP BY 1""",
    eu=L.ENERGY_USAGE_SQL))
def snk07(spark, d):
    path = TB.scratch_path(spark, "energy_usage")
    TB.write_chunked(L.energy_usage(spark, d), path, "1 day")
    back = spark.read.parquet(path)
    return back.groupBy("chunk").agg(F.count("*").alias("n"))


@register("snk08_compact_cold_chunks", "SNK-08", L.with_ctes("""
SELECT CAST(ts AS DATE) AS chunk, count(*) AS n FROM em GROUP BY 1""", em=L.EMISSION_METRICS_SQL))
def snk08(spark, d):
    path = TB.scratch_path(spark, "emission_metrics")
    em = L.emission_metrics(spark, d)
    TB.write_chunked(em, path, "1 day")
    # compact the table in place: read from the path, rewrite its cold chunks
    TB.compact_cold(spark.read.parquet(path), path, as_of="2024-01-30 00:00:00", older_than_days=14)
    return spark.read.parquet(path).groupBy("chunk").agg(F.count("*").alias("n"))


NOON = "2024-01-30 12:00:00"


@register("snk08_compact_noon_cutoff", "SNK-08", L.with_ctes("""
SELECT width, ts, facility_id, co2_kg FROM em, (VALUES ('1 day'), ('1 week')) w(width)""", em=L.EMISSION_METRICS_SQL))
def snk08_noon(spark, d):
    """A cut-off within a chunk: every row of the table is still there."""
    out = None
    for width in ("1 day", "1 week"):
        path = TB.scratch_path(spark, "noon")
        TB.write_chunked(L.emission_metrics(spark, d), path, width)
        TB.compact_cold(spark.read.parquet(path), path, as_of=NOON, older_than_days=14)
        rows = spark.read.parquet(path).select(F.lit(width).alias("width"), "ts", "facility_id", "co2_kg")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("snk09_expired_chunks", "SNK-09", L.with_ctes("""
SELECT ts, facility_id, kwh FROM eu WHERE ts >= date_trunc('day', TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 DAY)""",
    eu=L.ENERGY_USAGE_SQL))
def snk09_chunks(spark, d):
    path = TB.scratch_path(spark, "expires")
    TB.write_chunked(L.energy_usage(spark, d), path, "1 day")
    TB.expire_chunks(spark, path, NOON, 10)
    return spark.read.parquet(path).select("ts", "facility_id", "kwh")


@register("snk04_merge_moved_rows", "SNK-04", L.with_ctes("""
SELECT ts + CASE WHEN facility_id % 3 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS ts, reading_id, value
FROM (SELECT ts, user_id AS facility_id, event_id AS reading_id, value FROM events)"""))
def snk04_moved(spark, d):
    """Rows whose time moves to another chunk leave their old one; run twice."""
    e = L.table(spark, d, "events").select("ts", F.col("event_id").alias("reading_id"), "value",
                                           (F.col("user_id") % 3 == 0).alias("_moves"))
    path = TB.scratch_path(spark, "moves")
    TB.write_chunked(e.drop("_moves"), path, "1 day")
    moved = e.filter("_moves").drop("_moves").withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 DAYS"))
    for _ in range(2):
        TB.merge_into_chunks(path, moved, "reading_id")
    return spark.read.parquet(path).select("ts", "reading_id", "value")


@register("snk02_append_runs", "SNK-02", L.with_ctes("""
SELECT record_id, 1 AS version, CASE WHEN ts < TIMESTAMP '1995-01-01' THEN 'a' ELSE 'b' END AS run_id FROM rc""",
    rc=L.EMISSION_RECORDS_SQL))
def snk02_runs(spark, d):
    """Two runs appended, the first retried: each run's rows are there once."""
    rc, path = L.emission_records(spark, d), TB.scratch_path(spark, "runs")
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    for run, rows in (("a", rc.filter(F.col("ts") < cut)), ("b", rc.filter(F.col("ts") >= cut)), ("a", rc.filter(F.col("ts") < cut))):
        TB.append_run(TB.stamp_new_records(rows, 1, "2024-07-01 00:00:00"), path, run)
    return spark.read.parquet(path).select("record_id", "version", "run_id")


@register("snk09_retention", "SNK-09", L.with_ctes("""
SELECT record_id, ts FROM rc WHERE ts >= (SELECT max(ts) FROM rc) - INTERVAL 365 DAY""", rc=L.EMISSION_RECORDS_SQL))
def snk09(spark, d):
    rc = L.emission_records(spark, d)
    return TB.retain(rc, rc.select(F.max("ts")).scalar(), TB.RETENTION_DAYS["raw"]).select("record_id", "ts")


@register("snk10_prediction_rows", "SNK-10", L.with_ctes("""
SELECT ts, facility_id, co2_kg AS co2e_kg, anomaly_score AS explained, 'baseline-v1' AS model_version FROM em""",
    em=L.EMISSION_METRICS_SQL))
def snk10(spark, d):
    em = L.emission_metrics(spark, d)
    scored = em.select("ts", "facility_id", F.col("co2_kg").alias("co2e_kg"),
                       F.create_map(F.lit("anomaly_score"), F.col("anomaly_score")).alias("explanations"))
    path = TB.scratch_path(spark, "predictions")
    for _ in range(2):                                   # a retried run writes its rows once
        TB.append_run(TB.prediction_rows(scored, "baseline-v1"), path, "run-1")
    back = spark.read.parquet(path)
    return back.select("ts", "facility_id", "co2e_kg", "model_version",
                       F.get_json_object("explanations", "$.anomaly_score").cast("double").alias("explained"))


@register("snk11_run_log", "SNK-11", L.with_ctes("""
SELECT 'run-1' AS run_id, 'batch' AS kind, count(*) AS batch_size, count_if(value IS NOT NULL) AS success_count
FROM sf""", sf=L.SENSOR_FEED_SQL))
def snk11(spark, d):
    res = L.sensor_feed(spark, d).withColumn("ok", F.col("value").isNotNull())
    return TB.run_log(res, "run-1", "batch", "ok")


@register("snk12_report_export", "SNK-12")
def snk12(spark, d):
    from verdigris.operators.reports import esg_daily, esg_period_totals
    eu, wu, em = L.energy_usage(spark, d), L.water_usage(spark, d), L.emission_metrics(spark, d)
    table = esg_daily(eu, wu, em, 7, "2024-01-01 00:00:00", "2024-01-30 23:59:59")
    totals = esg_period_totals(eu, wu, em, "month")
    path = TB.scratch_path(spark, "report")
    TB.export_report(table, totals, path)
    return spark.read.option("header", True).csv(f"{path}/table")


@register("snk04_merge_written_table", "SNK-04", L.with_ctes(f"""
SELECT s.record_id, {sql_r('CASE WHEN u.record_id IS NOT NULL THEN coalesce(u.co2_kg, s.co2_kg) ELSE s.co2_kg END')} AS co2_kg,
       CASE WHEN u.record_id IS NOT NULL THEN s.version + 1 ELSE s.version END AS version
FROM sr s LEFT JOIN up u USING (record_id)""", rc=L.EMISSION_RECORDS_SQL, sr=STAMPED_SQL, up=UPDATES_SQL))
def snk04m(spark, d):
    path = TB.scratch_path(spark, "records")
    stamped = lambda lines: TB.stamp_new_records(L.records_of(lines, "created_by", "chunk"), F.col("created_by"), AS_OF)
    TB.write_chunked(L.owned_lines(spark, d), path, "7 days", order=["order_key"], made=stamped, at="l_shipdate")
    table = spark.read.parquet(path)
    updates = stored(_updates(spark, d), "updates")
    changed = TB.apply_updates(TB.rows_with_keys(table, updates, "record_id"), updates, user_id=0, is_admin=True, as_of=UPDATE_AT)
    TB.merge_into_chunks(path, changed, "record_id", width="7 days")
    back = spark.read.parquet(path)
    return back.select("record_id", r("co2_kg").alias("co2_kg"), "version")


@register("snk01_written_runs", "SNK-01", L.with_ctes("""
SELECT ts, facility_id, kwh, row_no, run_id FROM (
  SELECT *, CASE status WHEN 'F' THEN 'a' ELSE 'b' END AS run_id,
         row_number() OVER (PARTITION BY ts, facility_id ORDER BY CASE status WHEN 'F' THEN 0 ELSE 1 END, row_no) AS rn FROM st) WHERE rn = 1""",
    st=STAGED_SQL))
def snk01_written(spark, d):
    """Two runs into one table; each is retried, the first after the second."""
    st, path = _staged(spark, d), TB.scratch_path(spark, "inserted")
    first, rest = st.filter(F.col("status") == "F"), st.filter(F.col("status") != "F")
    for run, rows in (("a", first), ("b", rest), ("b", rest)):
        TB.insert_ignore_run(rows, path, run, ["ts", "facility_id"], ["row_no"])
    return spark.read.parquet(path).select("ts", "facility_id", "kwh", "row_no", "run_id")


@register("snk03_created_record", "SNK-03", L.with_ctes(f"""
SELECT record_id, {sql_r('co2e_kg')} AS co2e_kg, 99 AS created_by, TIMESTAMP '{AS_OF}' AS created_at, 1 AS version
FROM rc WHERE order_key = (SELECT max(order_key) FROM rc)""", rc=RECORDS_CO2E_SQL))
def snk03_created(spark, d):
    """The records of one order, created one by one: appended, one of them
    retried, and read back."""
    path, rc = TB.scratch_path(spark, "created"), L.emission_records(spark, d)
    newest = rc.where(F.col("order_key") == F.lit(rc.agg(F.max("order_key")).first()[0]))
    ids = [x.record_id for x in newest.select("record_id").distinct().orderBy("record_id").collect()]  # an order's lines
    for n, record_id in [*enumerate(ids), (0, ids[0])]:
        TB.append_run(TB.stamp_new_records(newest.where(F.col("record_id") == record_id), 99, AS_OF), path, f"create-{n}")
    return spark.read.parquet(path).select("record_id", r("co2e_kg").alias("co2e_kg"), "created_by", "created_at", "version")


@register("snk06_audit_values", "SNK-06", L.with_ctes(f"""
SELECT coalesce(o.record_id, n.record_id) AS record_id,
       CASE WHEN o.record_id IS NULL THEN 'C' WHEN n.record_id IS NULL THEN 'D' WHEN n.deleted_at IS NOT NULL THEN 'D' ELSE 'U' END AS operation_type,
       {sql_r('o.co2_kg')} AS old_co2, {sql_r('n.co2_kg')} AS new_co2, o.water_l AS old_water, n.water_l AS new_water,
       CASE WHEN n.deleted_at IS NOT NULL THEN '2024-08-01' END AS new_deleted, 0 AS changed_by, TIMESTAMP '{DELETE_AT}' AS changed_at
FROM (SELECT record_id, co2_kg, energy_kwh, water_l FROM sr WHERE ts < TIMESTAMP '2001-10-01 00:00:00') o
FULL JOIN (SELECT s.record_id, coalesce(u.co2_kg, s.co2_kg) AS co2_kg, s.energy_kwh, coalesce(u.water_l, s.water_l) AS water_l,
                  CASE WHEN k.record_id IS NOT NULL THEN 1 END AS deleted_at
           FROM sr s LEFT JOIN (SELECT record_id, max(co2_kg) AS co2_kg, max(water_l) AS water_l FROM up GROUP BY 1) u USING (record_id)
           LEFT JOIN (SELECT DISTINCT record_id FROM dk) k USING (record_id)
           WHERE s.ts >= TIMESTAMP '1995-02-01 00:00:00') n USING (record_id)
WHERE o.record_id IS NULL OR n.record_id IS NULL OR n.deleted_at IS NOT NULL OR o.co2_kg IS DISTINCT FROM n.co2_kg OR o.water_l IS DISTINCT FROM n.water_l""",
    rc=L.EMISSION_RECORDS_SQL, sr=STAMPED_SQL, dk=DELETE_KEYS_SQL, up=UPDATES_SQL))
def snk06_values(spark, d):
    """The audit log as written (one run, retried), its JSON read back."""
    st = _stamped(spark, d)
    old = st.filter(F.col("ts") < F.lit("2001-10-01").cast("timestamp_ntz"))
    new = st.filter(F.col("ts") >= F.lit("1995-02-01").cast("timestamp_ntz"))
    new = TB.apply_updates(new, _updates(spark, d), user_id=0, is_admin=True, as_of=UPDATE_AT)
    new = TB.soft_delete(new, _delete_keys(spark, d), is_admin=True, as_of=DELETE_AT)
    a = TB.audit_trail(old, new, "record_id", ["co2_kg", "energy_kwh", "water_l", "deleted_at"], changed_by=0, as_of=DELETE_AT)
    a, path = stored(a, "audit-rows"), TB.scratch_path(spark, "audit")
    for _ in range(2):                                   # the retry writes again what was found once
        TB.append_run(a, path, "run-1")
    kind = "struct<co2_kg:double,energy_kwh:double,water_l:double,deleted_at:string>"
    back = spark.read.parquet(path).withColumn("o", F.from_json("old_values", kind)).withColumn("n", F.from_json("new_values", kind))
    return back.select("record_id", "operation_type", r("o.co2_kg").alias("old_co2"), r("n.co2_kg").alias("new_co2"),
                       F.col("o.water_l").alias("old_water"), F.col("n.water_l").alias("new_water"),
                       F.substring("n.deleted_at", 1, 10).alias("new_deleted"), "changed_by", "changed_at")


@register("snk11_appended_log", "SNK-11", L.with_ctes("""
SELECT kind AS run_id, 'batch' AS kind, count(*) AS batch_size, count_if(value IS NOT NULL) AS success_count
FROM sf GROUP BY 1""", sf=L.SENSOR_FEED_SQL))
def snk11_log(spark, d):
    """A log row for each run, one of them retried."""
    feed, path = L.sensor_feed(spark, d).withColumn("ok", F.col("value").isNotNull()), TB.scratch_path(spark, "run-log")
    kinds = ("click", "error", "purchase", "signup", "view")
    for run in (*kinds, kinds[0]):
        TB.append_run(TB.run_log(feed.where(F.col("kind") == run), run).drop("run_id"), path, run)
    return spark.read.parquet(path).select("run_id", "kind", "batch_size", "success_count")


@register("snk12_report_values", "SNK-12", L.with_ctes(f"""
SELECT 'day' AS part, CAST(day AS VARCHAR) AS day, {sql_r('sum(e)')} AS energy, {sql_r('sum(w)')} AS water, {sql_r('sum(c)')} AS emissions FROM (
  SELECT CAST(ts AS DATE) AS day, kwh AS e, NULL AS w, NULL AS c FROM eu WHERE facility_id = 7
  UNION ALL SELECT CAST(ts AS DATE), NULL, cubic_meters, NULL FROM wu WHERE facility_id = 7
  UNION ALL SELECT CAST(ts AS DATE), NULL, NULL, co2_kg FROM em WHERE facility_id = 7) GROUP BY day
UNION ALL SELECT 'total', NULL, {sql_r('(SELECT sum(kwh) FROM eu WHERE ts >= (SELECT max(ts) FROM em) - INTERVAL 7 DAY)')},
  {sql_r('(SELECT sum(cubic_meters) FROM wu WHERE ts >= (SELECT max(ts) FROM em) - INTERVAL 7 DAY)')},
  {sql_r('(SELECT sum(co2_kg) FROM em WHERE ts >= (SELECT max(ts) FROM em) - INTERVAL 7 DAY)')}""",
    eu=L.ENERGY_USAGE_SQL, wu=L.WATER_USAGE_SQL, em=L.EMISSION_METRICS_SQL))
def snk12_values(spark, d):
    """The exported files, read back: the CSV table and the JSON totals."""
    from verdigris.operators.reports import esg_daily, esg_period_totals
    eu, wu, em = L.energy_usage(spark, d), L.water_usage(spark, d), L.emission_metrics(spark, d)
    path = TB.scratch_path(spark, "report-values")
    for _ in range(2):
        TB.export_report(esg_daily(eu, wu, em, 7, "1900-01-01 00:00:00", "2999-01-01 00:00:00"), esg_period_totals(eu, wu, em, "week"), path)
    table = spark.read.option("header", True).csv(f"{path}/table").select(
        F.lit("day").alias("part"), F.substring("bucket", 1, 10).alias("day"), *[F.col(c).cast("double").alias(c) for c in ("energy", "water", "emissions")])
    totals = spark.read.json(f"{path}/metadata").select(F.lit("total").alias("part"), F.lit(None).cast("string").alias("day"), F.col("total_energy").alias("energy"),
                                                        F.col("total_water").alias("water"), F.col("total_emissions").alias("emissions"))
    return table.unionByName(totals).select("part", "day", *[r(c).alias(c) for c in ("energy", "water", "emissions")])
