"""Registered checks: file sources and sensor feeds (SRC-01..09, SET-01).

The file checks first write files derived from the driver tables into the
shared checkpoint folder, then load them back through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import time as TF
from verdigris.operators.tables import scratch_path
from verdigris.plans import logical as L
from verdigris.plans.catalog import register
from verdigris.sources import files as SF
from verdigris.sources import sensors as SS


def _historical_rows(spark, d):
    """orders -> historical meter export rows with mixed timestamp layouts and
    some non-numeric kWh values."""
    o = L.table(spark, d, "orders")
    t = o.o_orderdate + F.make_dt_interval(mins=(F.col("o_orderkey") % 720).cast("int"))
    k = F.col("o_orderkey") % 3
    ts = (F.when(k == 0, TF.format_ntz(t, TF.TIMESTAMP_FORMATS[0]))
           .when(k == 1, TF.format_ntz(t, TF.TIMESTAMP_FORMATS[1]))
           .otherwise(TF.format_ntz(t, TF.TIMESTAMP_FORMATS[2])))
    kwh = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return o.select(ts.alias("Timestamp"), F.col("o_custkey").cast("string").alias("FacilityID"),
                    kwh.alias("Energy_kWh"), F.col("o_orderpriority").alias("Source"),
                    F.col("o_orderstatus").alias("_part"))


HISTORICAL_SQL = """
SELECT o_orderdate + INTERVAL (o_orderkey % 720) MINUTE AS ts, o_custkey AS facility_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS kwh, o_orderpriority AS source,
       o_orderstatus AS part
FROM orders"""


def _write_landing(spark, d):
    root = scratch_path(spark, "landing")
    rows = _historical_rows(spark, d)
    for status in ("F", "O"):     # two sub-folders of CSV files
        (rows.filter(F.col("_part") == status).drop("_part").write.option("header", True)
             .csv(f"{root}/csv/status={status}"))
    rows.filter(F.col("_part") == "P").drop("_part").write.json(f"{root}/json")
    rows.filter(F.col("_part") == "P").select(F.concat_ws("|", "Timestamp", "FacilityID").alias("v")) \
        .write.text(f"{root}/txt")
    return root


@register("src01_set01_historical_csv", "SRC-01", L.with_ctes("""
SELECT ts, facility_id, kwh, source FROM h WHERE part IN ('F', 'O') AND kwh IS NOT NULL""", h=HISTORICAL_SQL))
def src01(spark, d):
    root = _write_landing(spark, d)
    ok, _ = SF.load_historical_csv(spark, f"{root}/csv")
    return ok.select("ts", F.col("facility_id").cast("bigint").alias("facility_id"), "kwh", "source")


@register("src01_val14_rejects", "VAL-14", L.with_ctes("""
SELECT ts, facility_id, source FROM h WHERE part IN ('F', 'O') AND kwh IS NULL""", h=HISTORICAL_SQL))
def src01r(spark, d):
    root = _write_landing(spark, d)
    _, bad = SF.load_historical_csv(spark, f"{root}/csv")
    return bad.select("ts", F.col("facility_id").cast("bigint").alias("facility_id"), "source")


@register("src02_historical_json", "SRC-02", L.with_ctes("""
SELECT ts, facility_id, kwh, source FROM h WHERE part = 'P' AND kwh IS NOT NULL""", h=HISTORICAL_SQL))
def src02(spark, d):
    root = _write_landing(spark, d)
    ok, _ = SF.load_historical_json(spark, f"{root}/json")
    return ok.select("ts", F.col("facility_id").cast("bigint").alias("facility_id"), "kwh", "source")


def _headers_differ(spark, d, root):
    """The export in two layouts: other column orders, an extra column, text ids."""
    rows = _historical_rows(spark, d).withColumn("FacilityID", F.concat(F.lit("plant-"), "FacilityID"))
    layouts = (["Timestamp", "FacilityID", "Energy_kWh", "Source"], ["Source", "Extra", "Energy_kWh", "Timestamp", "FacilityID"])
    for n, names in enumerate(layouts):
        (rows.withColumn("Extra", F.lit("x, y")).filter((F.length("FacilityID") % 2 == n)).select(*names)
             .write.option("header", True).csv(f"{root}/layout={n}"))
    return root


@register("src01_headers_by_name", "SRC-01", L.with_ctes("""
SELECT ts, 'plant-' || CAST(facility_id AS VARCHAR) AS facility_id, kwh, source FROM h WHERE kwh IS NOT NULL""", h=HISTORICAL_SQL))
def src01_names(spark, d):
    ok, _ = SF.load_historical_csv(spark, _headers_differ(spark, d, scratch_path(spark, "layouts")))
    return ok.select("ts", "facility_id", "kwh", "source")


@register("src01_quoted_line_breaks", "SRC-01", L.with_ctes("""
SELECT ts, 'plant ' || chr(10) || '"' || CAST(facility_id AS VARCHAR) || '", north' AS facility_id, kwh, source || chr(10) || chr(10) || 'two, three' AS source
FROM h WHERE kwh IS NOT NULL""", h=HISTORICAL_SQL))
def src01_quoted(spark, d):
    """Ids and sources with line breaks, commas and quotes, in two layouts."""
    rows, root = _historical_rows(spark, d), scratch_path(spark, "quoted")
    rows = (rows.withColumn("FacilityID", F.concat(F.lit('plant \n"'), "FacilityID", F.lit('", north')))
            .withColumn("Source", F.concat("Source", F.lit("\n\ntwo, three"))).withColumn("Note", F.lit("")))
    for n, names in enumerate((["Timestamp", "FacilityID", "Energy_kWh", "Source"], ["Note", "Source", "FacilityID", "Energy_kWh", "Timestamp"])):
        (rows.where((F.length("Energy_kWh") % 2) == n).select(*names).write.option("header", True).option("escape", '"')
             .option("quoteAll", True).csv(f"{root}/layout={n}"))
    ok, _ = SF.load_historical_csv(spark, root)
    return ok.select("ts", "facility_id", "kwh", "source")


@register("src03_file_inventory", "SRC-03", L.with_ctes("""
SELECT * FROM (VALUES ('csv', true), ('json', true), ('txt', false)) v(extension, supported)"""))
def src03(spark, d):
    root = _write_landing(spark, d)
    inv = SF.file_inventory(spark, root)
    return inv.select("extension", "supported").distinct()


@register("src03_inventory_files", "SRC-03", L.with_ctes("""
SELECT 'csv' AS extension, true AS supported, count(*) AS files, sum(length(CAST(n AS VARCHAR)) + 1)::BIGINT AS bytes
FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)
UNION ALL SELECT 'json', true, count(*), sum(length(CAST(n AS VARCHAR)) + 7)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)
UNION ALL SELECT 'txt', false, count(*), sum(length(CAST(n AS VARCHAR)) + 1)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)"""))
def src03_files(spark, d):
    """A known number of files of known sizes: one for each group, with its count."""
    o, root = L.table(spark, d, "orders"), scratch_path(spark, "inventory")
    for fmt, keys in (("csv", ["o_orderstatus", "o_orderpriority"]), ("json", ["o_orderstatus"]), ("text", ["o_orderpriority"])):
        n = F.count("*").cast("string") if fmt == "text" else F.count("*")
        (o.groupBy(*keys).agg(n.alias("n")).repartition(*keys).write.partitionBy(*keys).format(fmt).save(f"{root}/{fmt}"))
    return (SF.file_inventory(spark, root).groupBy("extension", "supported")
            .agg(F.countDistinct("path").alias("files"), F.sum("length").alias("bytes")))


@register("src03_ingest_report", "SRC-03", L.with_ctes("""
SELECT 'csv' AS extension, true AS supported,
       count(*) FILTER (WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW') AS rows_loaded FROM orders
UNION ALL SELECT 'json', true, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW') FROM orders
UNION ALL SELECT 'txt', false, 0"""))
def src03r(spark, d):
    root = _write_landing(spark, d)
    rep = SF.ingest_report(spark, root)
    return rep.groupBy("extension", "supported").agg(F.sum("rows_loaded").alias("rows_loaded"))


@register("src04_raw_staging", "SRC-04", L.with_ctes("""
SELECT strftime(ts, '%Y-%m-%d') || '|' || CAST(facility_id AS VARCHAR) || '|' || source AS raw_data,
       TIMESTAMP '2024-06-01 00:00:00' AS ingested_at FROM h""", h=HISTORICAL_SQL))
def src04(spark, d):
    # every row of the export as a line of text, staged as it is
    o = L.table(spark, d, "orders")
    root = scratch_path(spark, "staging")
    o.select(F.concat_ws("|", F.date_format(o.o_orderdate + F.make_dt_interval(mins=(F.col("o_orderkey") % 720).cast("int")),
                                            "yyyy-MM-dd"), "o_custkey", "o_orderpriority")).write.text(f"{root}/part")
    return SF.stage_raw(spark, root, "2024-06-01 00:00:00", "*.txt").select("raw_data", "ingested_at")


@register("src05_parquet_columns", "SRC-05", L.with_ctes("SELECT l_orderkey, l_quantity FROM lineitem"))
def src05(spark, d):
    return SF.read_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@register("src07_bulk_read", "SRC-07", L.with_ctes("""
SELECT reading_id, sensor_id, value FROM sf WHERE kind IN ('click', 'view', 'purchase', 'signup')""",
    sf=L.SENSOR_FEED_SQL))
def src07(spark, d):
    sf = L.sensor_feed(spark, d)
    ok, _ = SS.bulk_read(sf.withColumn("status", F.when(F.col("error").isNotNull(), F.lit("failed"))))
    return ok.select("reading_id", "sensor_id", "value")


@register("src08_failed_readings", "SRC-08", L.with_ctes("""
SELECT reading_id, sensor_id, error FROM sf WHERE error IS NOT NULL""", sf=L.SENSOR_FEED_SQL))
def src08(spark, d):
    _, failed = SS.split_failed_readings(L.sensor_feed(spark, d))
    return failed.select("reading_id", "sensor_id", "error")


KINDS = ("click", "view", "purchase", "signup")


@register("src09_long_to_wide", "SRC-09", L.with_ctes("""
SELECT facility_id, hour, """ + ", ".join(
    f"arg_max(CASE WHEN event_type = '{k}' THEN value END, CASE WHEN event_type = '{k}' THEN ts END) AS {k}"
    for k in KINDS) + """
FROM (SELECT user_id AS facility_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, ts, event_type, value
      FROM events WHERE event_type <> 'error') GROUP BY 1, 2""", ))
def src09(spark, d):
    e = L.table(spark, d, "events").filter(F.col("event_type") != "error")
    long = e.select(F.col("user_id").alias("facility_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
                    "ts", F.col("event_type").alias("sensor_kind"), "value")
    return SF.long_to_wide(long, KINDS, keys=["facility_id", "hour"])
