"""Engine-neutral rounding for oracle comparisons."""

from pyspark.sql import functions as F

R4 = 4


def r(c, n=R4):
    """Round half up with plain double arithmetic, identical in both engines
    (Spark's ``round`` goes through decimal text, DuckDB's through binary).
    The 1e-4 ulp nudge keeps exact halves (common for averages of
    two-decimal data) from splitting on summation-order noise."""
    x = F.col(c) if isinstance(c, str) else c
    k = float(10 ** n)
    return F.floor(x * k + 0.5001) / k


def sql_r(expr: str, n: int = R4) -> str:
    k = 10 ** n
    return f"(floor(({expr}) * {k} + 0.5001) / {k})"
