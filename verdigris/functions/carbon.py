"""Carbon arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.time import col_

# Fixed values (ours, IPCC AR5 100-year global warming potentials).
GWP_CH4 = 28.0
GWP_N2O = 265.0


def co2e_kg(co2_kg, ch4_g, n2o_g, gwp_ch4: float = GWP_CH4, gwp_n2o: float = GWP_N2O) -> Column:
    """CO2-equivalent in kg; missing CH4/N2O count as 0."""
    return (col_(co2_kg)
            + F.coalesce(col_(ch4_g), F.lit(0.0)) / 1000 * gwp_ch4
            + F.coalesce(col_(n2o_g), F.lit(0.0)) / 1000 * gwp_n2o)


def carbon_intensity(co2e, energy) -> Column:
    """co2e / energy; 0 when energy is 0; NULL when either input is NULL."""
    c, e = col_(co2e), col_(energy)
    return (F.when(c.isNull() | e.isNull(), F.lit(None).cast("double"))
             .when(e == 0, F.lit(0.0))
             .otherwise(F.try_divide(c, e)))


def scenario_energy(energy, efficiency, renewable) -> Column:
    """What-if energy: x(1-eff), then x(1-0.3 r) when r > 0."""
    base = col_(energy) * (1 - col_(efficiency))
    return F.when(col_(renewable) > 0, base * (1 - 0.3 * col_(renewable))).otherwise(base)


def scenario_water(water, efficiency) -> Column:
    return col_(water) * (1 - col_(efficiency))


def interval_bounds(pred, sigma, z: float = 1.96):
    """(lower, upper) of a normal interval, rounded to 2 places."""
    return (F.round(col_(pred) - z * col_(sigma), 2), F.round(col_(pred) + z * col_(sigma), 2))


def to_wei(credits) -> Column:
    """Whole-credit decimal -> integer token units (truncate toward zero)."""
    return (col_(credits).cast("decimal(38,18)") * F.lit(10 ** 18).cast("decimal(38,0)")).cast("decimal(38,0)")


def from_wei(wei, scale: int = 18) -> Column:
    """Token units -> credits as decimal(38,18), exact to the last unit: the
    digits are moved as text, as a quotient of decimals keeps six places only."""
    w = col_(wei).cast("decimal(38,0)")
    digits = F.lpad(F.abs(w).cast("string"), 39, "0")
    text = F.concat(F.when(w < 0, F.lit("-")).otherwise(F.lit("")), F.substring(digits, 1, 21), F.lit("."),
                    F.substring(digits, 22, 18))
    return text.cast(f"decimal(38,{scale})")
