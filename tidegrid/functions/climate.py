"""Psychrometrics and light, as column expressions. Temperatures in °C, pressure in kPa."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import col

# Magnus/Tetens coefficients, moist-air constants (ASHRAE).
TETENS_A, TETENS_B = 17.27, 237.3
TETENS_BASE = 0.61078
MAGNUS_BASE = 0.6108
VAPOUR_RATIO = 0.621945
CP_AIR, CP_VAPOUR, LATENT_HEAT = 1.006, 1.86, 2501.0
R_DRY_AIR, VOLUME_FACTOR = 0.287042, 1.6078
PSYCHROMETRIC = 0.0665
SEA_LEVEL = 101.325
PAR_PER_WATT = 4.57


def _pressure(t: Column, base: float) -> Column:
    return F.lit(base) * F.exp(F.lit(TETENS_A) * t / (t + F.lit(TETENS_B)))


def saturation_pressure(temp) -> Column:
    return _pressure(col(temp), TETENS_BASE)


def vpd(temp, rh) -> Column:
    """Vapour pressure deficit, never below zero."""
    raw = saturation_pressure(temp) * (1 - col(rh) / 100)
    return F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))


def hpa_to_kpa(c) -> Column:
    return col(c) / 10


def dew_point(temp, rh) -> Column:
    t = col(temp)
    g = F.lit(TETENS_A) * t / (F.lit(TETENS_B) + t) + F.ln(col(rh) / 100)
    return F.lit(TETENS_B) * g / (F.lit(TETENS_A) - g)


def wet_bulb(temp, rh) -> Column:
    """Stull (2011)."""
    t, h = col(temp), col(rh)
    return (t * F.atan(0.151977 * F.sqrt(h + 8.313659)) + F.atan(t + h) - F.atan(h - 1.676331)
            + 0.00391838 * F.pow(h, 1.5) * F.atan(0.023101 * h) - 4.686035)


def humidity_ratio(temp, rh, pressure: float = SEA_LEVEL) -> Column:
    e = _pressure(col(temp), MAGNUS_BASE) * col(rh) / 100
    return F.lit(VAPOUR_RATIO) * e / (F.lit(pressure) - e)


def enthalpy(temp, ratio) -> Column:
    t = col(temp)
    return CP_AIR * t + col(ratio) * (LATENT_HEAT + CP_VAPOUR * t)


def specific_volume(temp, ratio, pressure: float = SEA_LEVEL) -> Column:
    return R_DRY_AIR * (col(temp) + 273.15) * (1 + VOLUME_FACTOR * col(ratio)) / F.lit(pressure)


def bowen_ratio(temp, rh, leaf_temp) -> Column:
    """Sensible over latent heat; 0 where the leaf deficit vanishes."""
    t, leaf = col(temp), col(leaf_temp)
    gap = _pressure(leaf, MAGNUS_BASE) - _pressure(t, MAGNUS_BASE) * col(rh) / 100
    return F.when(gap > 0.001, PSYCHROMETRIC * (leaf - t) / gap).otherwise(0.0)


def condensation_risk(surface, temp, rh, margin: float = 5.0) -> Column:
    """1 at or below the dew point, falling linearly to 0 at ``margin`` °C above it."""
    above = col(surface) - dew_point(temp, rh)
    return F.when(above.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - above / margin)))


def lamps_on(lamps) -> Column:
    """How many lamps report on; unknown counts as off."""
    total = F.lit(0)
    for lamp in lamps:
        total = total + F.coalesce(col(lamp).cast("int"), F.lit(0))
    return total


def lamp_output(groups: Mapping[str, tuple[float, int]]) -> Column:
    """Sum over lamp groups of on x rating x number of lamps (PPF or kW)."""
    total = F.lit(0.0)
    for name, (rating, count) in groups.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * (rating * count)
    return total


def total_ppfd(natural, supplemental) -> Column:
    return F.coalesce(col(natural).cast("double"), F.lit(0.0)) + F.coalesce(col(supplemental), F.lit(0.0))


def watts_to_ppfd(c) -> Column:
    return col(c) * PAR_PER_WATT
