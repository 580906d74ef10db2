"""Registered checks: carbon-credit ledger (LED-01..07, JOIN-08/09,
SRT-04/05, SNK-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import ledger as LG
from verdigris.plans import logical as L
from verdigris.plans.catalog import register
from verdigris.plans.rounding import r, sql_r

DELTAS_SQL = """
SELECT seq, block, kind, to_acct AS account, amount_wei AS delta FROM ce WHERE to_acct IS NOT NULL
UNION ALL
SELECT seq, block, kind, from_acct AS account, -amount_wei AS delta FROM ce WHERE from_acct IS NOT NULL"""


@register("led01_balances", "LED-01", L.with_ctes("""
SELECT account, CAST(sum(delta) AS VARCHAR) AS balance_wei FROM dl GROUP BY account""",
    ce=L.CREDIT_EVENTS_SQL, dl=DELTAS_SQL))
def led01(spark, d):
    b = LG.balances(L.credit_events(spark, d))
    return b.select("account", F.col("balance_wei").cast("string").alias("balance_wei"))


@register("led02_total_supply", "LED-02", L.with_ctes("""
SELECT CAST(coalesce(sum(CASE WHEN kind = 'mint' THEN amount_wei END), 0)
          - coalesce(sum(CASE WHEN kind = 'burn' THEN amount_wei END), 0) AS VARCHAR) AS total_supply_wei FROM ce""",
    ce=L.CREDIT_EVENTS_SQL))
def led02(spark, d):
    t = LG.total_supply(L.credit_events(spark, d))
    return t.select(F.col("total_supply_wei").cast("string").alias("total_supply_wei"))


@register("led03_overdraft_screen", "LED-03", L.with_ctes("""
SELECT account, seq, kind, CAST(running_wei AS VARCHAR) AS running_wei FROM (
  SELECT *, row_number() OVER (PARTITION BY account ORDER BY seq, delta DESC) AS rn FROM (
    SELECT *, sum(delta) OVER (PARTITION BY account ORDER BY seq, delta DESC
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_wei FROM dl)
  WHERE running_wei < 0) WHERE rn = 1""", ce=L.CREDIT_EVENTS_SQL, dl=DELTAS_SQL))
def led03(spark, d):
    o = LG.overdraft_screen(L.credit_events(spark, d), seq_per_bucket=4096)
    return o.select("account", "seq", "kind", F.col("running_wei").cast("string").alias("running_wei"))


@register("led04_zero_address_refused", "LED-04", L.with_ctes("""
SELECT seq FROM ce WHERE kind = 'transfer' AND (to_acct IS NULL OR to_acct = 0)""", ce=L.CREDIT_EVENTS_SQL))
def led04(spark, d):
    _, bad = LG.refuse_zero_address(L.credit_events(spark, d))
    return bad.select("seq")


APPROVALS_SQL = """SELECT seq, from_acct AS owner, to_acct AS spender, amount_wei FROM ce
WHERE kind = 'transfer' AND memo IN ('1-URGENT', '2-HIGH')"""
SPENDS_SQL = """SELECT seq, from_acct AS owner, to_acct AS spender, amount_wei FROM ce
WHERE kind = 'transfer' AND memo NOT IN ('1-URGENT', '2-HIGH')"""


def _approvals_spends(spark, d):
    ce = L.credit_events(spark, d).filter(F.col("kind") == "transfer")
    sel = ce.select("seq", F.col("from_acct").alias("owner"), F.col("to_acct").alias("spender"), "amount_wei", "memo")
    appr = sel.filter(F.col("memo").isin("1-URGENT", "2-HIGH")).drop("memo")
    spend = sel.filter(~F.col("memo").isin("1-URGENT", "2-HIGH")).drop("memo")
    return appr, spend


@register("led05_allowances", "LED-05", L.with_ctes("""
SELECT a.owner, a.spender, a.seq AS approved_seq, CAST(a.amount_wei AS VARCHAR) AS approved_wei,
       CAST(a.amount_wei - coalesce(sum(CASE WHEN s.seq > a.seq THEN s.amount_wei END), 0) AS VARCHAR) AS remaining_wei
FROM (SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY owner, spender ORDER BY seq DESC) = 1) a
LEFT JOIN sp s ON s.owner = a.owner AND s.spender = a.spender
GROUP BY a.owner, a.spender, a.seq, a.amount_wei""", ce=L.CREDIT_EVENTS_SQL, ap=APPROVALS_SQL, sp=SPENDS_SQL))
def led05(spark, d):
    appr, spend = _approvals_spends(spark, d)
    a = LG.allowances(appr, spend)
    return a.select("owner", "spender", "approved_seq", F.col("approved_wei").cast("string").alias("approved_wei"),
                    F.col("remaining_wei").cast("string").alias("remaining_wei"))


def _grants(spark, d):
    u = L.users(spark, d)
    return u.filter(F.col("role") == "admin").select(F.col("user_id").alias("account"), F.lit("minter").alias("role"))


@register("led06_join08_refused_mints", "LED-06", L.with_ctes("""
SELECT seq, operator FROM ce WHERE kind = 'mint' AND operator NOT IN (SELECT user_id FROM us WHERE role = 'admin')""",
    ce=L.CREDIT_EVENTS_SQL, us=L.USERS_SQL))
def led06(spark, d):
    _, refused = LG.mint_authority(L.credit_events(spark, d), _grants(spark, d))
    return refused.select("seq", "operator")


@register("join08_allowed_mints", "JOIN-08", L.with_ctes("""
SELECT seq, operator FROM ce WHERE kind = 'mint' AND operator IN (SELECT user_id FROM us WHERE role = 'admin')""",
    ce=L.CREDIT_EVENTS_SQL, us=L.USERS_SQL))
def join08(spark, d):
    ok, _ = LG.mint_authority(L.credit_events(spark, d), _grants(spark, d))
    return ok.select("seq", "operator")


@register("led07_srt04_join09_statement", "LED-07", L.with_ctes(f"""
SELECT account, seq, kind, block_time, {sql_r('CAST(abs(delta) AS DOUBLE) / 1e18')} AS amount_credits FROM (
  SELECT dl.*, b.block_time, row_number() OVER (PARTITION BY account ORDER BY seq DESC, delta ASC) AS rn
  FROM dl JOIN (SELECT DISTINCT block, block_time FROM ce) b USING (block))
WHERE rn <= 5""", ce=L.CREDIT_EVENTS_SQL, dl=DELTAS_SQL))
def led07(spark, d):
    ce = L.credit_events(spark, d)
    blocks = ce.select("block", "block_time").distinct()
    st = LG.statement(ce, blocks, limit=5)
    return st.select("account", "seq", "kind", "block_time",
                     r(F.col("amount_credits").cast("double")).alias("amount_credits"))


@register("srt05_recent_transfers", "SRT-05", L.with_ctes("""
SELECT seq, block, to_acct FROM ce WHERE kind = 'transfer' AND from_acct = 7
  AND block >= (SELECT max(block) FROM ce) - 1000""", ce=L.CREDIT_EVENTS_SQL))
def srt05(spark, d):
    return LG.recent_transfers(L.credit_events(spark, d), 7, 1000).select("seq", "block", "to_acct")


@register("snk13_transfer_audit", "SNK-13", L.with_ctes(f"""
SELECT from_acct AS user_id, tx_hash, {sql_r('CAST(amount_wei AS DOUBLE) / 1e18')} AS amount, block_time AS "timestamp"
FROM ce WHERE kind = 'transfer'""", ce=L.CREDIT_EVENTS_SQL))
def snk13(spark, d):
    a = LG.transfer_audit(L.credit_events(spark, d))
    return a.select("user_id", "tx_hash", r(F.col("amount").cast("double")).alias("amount"), "timestamp")


@register("snk13_mint_audit", "SNK-13", L.with_ctes(f"""
SELECT operator AS admin_id, to_acct AS recipient, {sql_r('CAST(amount_wei AS DOUBLE) / 1e18')} AS amount, tx_hash,
       block_time AS "timestamp" FROM ce WHERE kind = 'mint'""", ce=L.CREDIT_EVENTS_SQL))
def snk13m(spark, d):
    a = LG.mint_audit(L.credit_events(spark, d))
    return a.select("admin_id", "recipient", r(F.col("amount").cast("double")).alias("amount"), "tx_hash", "timestamp")


@register("val16_led_addresses", "VAL-16", L.with_ctes("""
SELECT account, '0x' || lpad(lower(hex(account)), 40, '0') AS address FROM (SELECT DISTINCT to_acct AS account
FROM ce WHERE to_acct IS NOT NULL)""", ce=L.CREDIT_EVENTS_SQL))
def val16b(spark, d):
    ce = L.credit_events(spark, d)
    acc = ce.select(F.col("to_acct").alias("account")).filter(F.col("account").isNotNull()).distinct()
    return acc.select("account", LG.address("account").alias("address"))


@register("snk13_appended_audit", "SNK-13", L.with_ctes(f"""
SELECT kind, block % 3 AS run, tx_hash, coalesce(from_acct, operator) AS actor, {sql_r('CAST(amount_wei AS DOUBLE) / 1e18')} AS amount
FROM ce WHERE kind IN ('transfer', 'mint')""", ce=L.CREDIT_EVENTS_SQL))
def snk13_appended(spark, d):
    """Both audit logs over three runs, the first of them retried."""
    from verdigris.operators.tables import append_run, scratch_path
    ce, root = L.credit_events(spark, d), scratch_path(spark, "audit-logs")
    for n in (0, 1, 2, 0):
        part = ce.where(F.col("block") % 3 == n)
        append_run(LG.transfer_audit(part), f"{root}/transfers", str(n))
        append_run(LG.mint_audit(part), f"{root}/mints", str(n))
    logs = [spark.read.parquet(f"{root}/{name}").select(F.lit(kind).alias("kind"), F.col("run_id").cast("bigint").alias("run"), "tx_hash",
                                                        F.col(actor).alias("actor"), r(F.col("amount").cast("double")).alias("amount"))
            for name, kind, actor in (("transfers", "transfer", "user_id"), ("mints", "mint", "admin_id"))]
    return logs[0].unionByName(logs[1])
