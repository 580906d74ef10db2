"""Logical telemetry tables derived from the driver's parquet tables.

Each logical table has a Spark builder and the equivalent DuckDB SQL text,
so the oracle queries start from exactly the same rows.  Only projections
and filters are used, so Catalyst prunes columns and pushes predicates into
the parquet scan of whichever query consumes them.

Mapping (fixed by the test-data layout):

* ``emission_metrics``  <- events: ts, user_id -> facility_id,
  value -> co2_kg, props.k / 100 -> anomaly_score
* ``energy_usage``      <- events with event_type click/view, value -> kwh
* ``water_usage``       <- events with event_type purchase/signup,
  value -> cubic_meters
* ``sensor_feed``       <- all events; event_type 'error' is a failed reading
* ``emission_records``  <- lineitem: l_shipdate -> ts, l_suppkey -> device,
  l_extendedprice / 1000 -> co2_kg, 100 * l_tax -> ch4_g,
  100 * l_discount -> n2o_g, l_quantity -> energy_kwh,
  l_extendedprice -> water_l, returnflag || linestatus -> source_type
* ``facilities``        <- supplier x nation x region
* ``users``             <- customer (segment BUILDING = admin)
* ``credit_events``     <- orders: F mint, O transfer, P burn
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- metrics
def emission_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts"),
        F.col("user_id").alias("facility_id"),
        F.col("value").alias("co2_kg"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("anomaly_score"),
    )


EMISSION_METRICS_SQL = """
SELECT ts, user_id AS facility_id, value AS co2_kg,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS anomaly_score
FROM events"""


ENERGY_SOURCES = ("click", "view")
WATER_SOURCES = ("purchase", "signup")


def energy_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.filter(F.col("event_type").isin(*ENERGY_SOURCES))
             .select("ts", F.col("user_id").alias("facility_id"),
                     F.col("value").alias("kwh"), F.col("event_type").alias("source")))


ENERGY_USAGE_SQL = """
SELECT ts, user_id AS facility_id, value AS kwh, event_type AS source
FROM events WHERE event_type IN ('click', 'view')"""


def water_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.filter(F.col("event_type").isin(*WATER_SOURCES))
             .select("ts", F.col("user_id").alias("facility_id"),
                     F.col("value").alias("cubic_meters"), F.col("event_type").alias("source")))


WATER_USAGE_SQL = """
SELECT ts, user_id AS facility_id, value AS cubic_meters, event_type AS source
FROM events WHERE event_type IN ('purchase', 'signup')"""


def sensor_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reading feed: one row per event; 'error' rows are failed reads."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("reading_id"), "ts",
        F.col("user_id").alias("sensor_id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "error", F.lit("sensor timeout")).alias("error"),
        F.col("event_type").alias("kind"),
    )


SENSOR_FEED_SQL = """
SELECT event_id AS reading_id, ts, user_id AS sensor_id,
       CASE WHEN event_type <> 'error' THEN value END AS value,
       CASE WHEN event_type = 'error' THEN 'sensor timeout' END AS error,
       event_type AS kind
FROM events"""


# ---------------------------------------------------------------- records
def _record_columns() -> list:
    return [
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey",
                    (F.year("l_shipdate") * 10000 + F.month("l_shipdate") * 100
                     + F.dayofmonth("l_shipdate")).cast("string")).alias("record_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / 1000).alias("co2_kg"),
        (F.col("l_tax") * 100).alias("ch4_g"),
        (F.col("l_discount") * 100).alias("n2o_g"),
        F.col("l_quantity").alias("energy_kwh"),
        F.col("l_extendedprice").alias("water_l"),
        F.concat("l_returnflag", "l_linestatus").alias("source_type"),
        F.concat(F.lit("dev-"), F.col("l_suppkey").cast("string")).alias("device_id"),
        F.col("l_suppkey").alias("facility_id"),
        F.col("l_orderkey").alias("order_key"),
    ]


def emission_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_record_columns())


def owned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored columns of records joined with ``record_owners`` by order."""
    li = table(spark, sf_dir, "lineitem")
    return li.join(record_owners(spark, sf_dir), F.col("l_orderkey") == F.col("order_key")).drop("order_key")


def records_of(lines: DataFrame, *more: str) -> DataFrame:
    """``emission_records`` of lineitem rows, with ``more`` of their columns."""
    return lines.select(*_record_columns(), *more)


def owned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``emission_records`` joined with ``record_owners`` by order.  Derived
    columns are made after the join: its shuffle carries the stored columns,
    fewer and narrower than the texts and products made from them."""
    return records_of(owned_lines(spark, sf_dir), "created_by")


EMISSION_RECORDS_SQL = """
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS record_id,
       l_shipdate AS ts,
       l_extendedprice / 1000 AS co2_kg,
       l_tax * 100 AS ch4_g,
       l_discount * 100 AS n2o_g,
       l_quantity AS energy_kwh,
       l_extendedprice AS water_l,
       l_returnflag || l_linestatus AS source_type,
       'dev-' || CAST(l_suppkey AS VARCHAR) AS device_id,
       l_suppkey AS facility_id,
       l_orderkey AS order_key
FROM lineitem"""


def record_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_key -> created_by (the ordering customer)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("created_by"))


# ---------------------------------------------------------------- dimensions
def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
             .join(r, F.col("n_regionkey") == r.r_regionkey)
             .select(F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("name"),
                     F.struct(F.col("n_name").alias("nation"),
                              F.col("r_name").alias("region")).alias("location"),
                     F.col("r_name").alias("industry_type")))


FACILITIES_SQL = """
SELECT s_suppkey AS facility_id, s_name AS name, n_name AS nation, r_name AS region,
       r_name AS industry_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "admin")
                     .otherwise("user").alias("role"),
                    F.col("c_mktsegment").alias("segment"))


USERS_SQL = """
SELECT c_custkey AS user_id, c_name AS name,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'user' END AS role,
       c_mktsegment AS segment
FROM customer"""


# ---------------------------------------------------------------- ledger
WEI = 10 ** 18


def credit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only ledger event log.

    seq = o_orderkey, block = days since epoch of o_orderdate,
    amount = o_totalprice credits in wei (decimal(38,0)).  A transfer goes
    from the ordering customer to customer ``(custkey + orderkey + 1) mod N``
    where N = max(c_custkey) + 1 of the customer table.
    """
    o = table(spark, sf_dir, "orders")
    n_acct = table(spark, sf_dir, "customer").select(F.max("c_custkey") + 1).scalar()
    kind = (F.when(F.col("o_orderstatus") == "F", "mint")
             .when(F.col("o_orderstatus") == "O", "transfer")
             .when(F.col("o_orderstatus") == "P", "burn"))
    peer = F.pmod(F.col("o_custkey") + F.col("o_orderkey") + 1, n_acct)
    wei = (F.round(F.col("o_totalprice") * 100).cast("decimal(38,0)")
           * F.lit(10 ** 16).cast("decimal(38,0)")).cast("decimal(38,0)")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("block"),
        F.col("o_orderdate").alias("block_time"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("tx_hash"),
        kind.alias("kind"),
        F.when(kind != "mint", F.col("o_custkey")).alias("from_acct"),
        F.when(kind == "mint", F.col("o_custkey"))
         .when(kind == "transfer", peer).alias("to_acct"),
        F.col("o_custkey").alias("operator"),
        wei.alias("amount_wei"),
        F.col("o_orderpriority").alias("memo"),
    )


CREDIT_EVENTS_SQL = """
SELECT o_orderkey AS seq,
       CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS block,
       o_orderdate AS block_time,
       sha256(CAST(o_orderkey AS VARCHAR)) AS tx_hash,
       CASE o_orderstatus WHEN 'F' THEN 'mint' WHEN 'O' THEN 'transfer' WHEN 'P' THEN 'burn' END AS kind,
       CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS from_acct,
       CASE WHEN o_orderstatus = 'F' THEN o_custkey
            WHEN o_orderstatus = 'O' THEN (o_custkey + o_orderkey + 1) % (SELECT max(c_custkey) + 1 FROM customer)
       END AS to_acct,
       o_custkey AS operator,
       CAST(CAST(round(o_totalprice * 100) AS DECIMAL(38,0)) * CAST(10000000000000000 AS DECIMAL(38,0)) AS DECIMAL(38,0)) AS amount_wei,
       o_orderpriority AS memo
FROM orders"""


def with_ctes(body: str, **ctes: str) -> str:
    """Prefix ``body`` with a WITH clause of named logical tables."""
    if not ctes:
        return body
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {parts}\n{body}"
