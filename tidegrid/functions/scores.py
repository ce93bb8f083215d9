"""Scores, objectives, constraints and solar geometry as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import clip, col
from .climate import PAR_PER_WATT

# Name pattern -> trait category, first match wins.
CATEGORIES = {
    "growth": ("%growth%",),
    "morphology": ("%height%",),
    "flowering": ("%flower%",),
    "water_use": ("%water%",),
}


def delta(a, b) -> Column:
    return col(a) - col(b)


def from_midpoint(c, low: float, high: float) -> Column:
    return col(c) - (low + high) / 2


def in_range_flag(c, low: float, high: float) -> Column:
    return F.coalesce(col(c).between(low, high).cast("int"), F.lit(0))


def night_stress(c, is_day: Column, threshold: float, side: str = "high") -> Column:
    hit = col(c) > threshold if side == "high" else col(c) < threshold
    return F.coalesce((~is_day & hit).cast("int"), F.lit(0))


def category(name, rules: Mapping[str, tuple[str, ...]] = CATEGORIES, default: str = "other") -> Column:
    """Category by LIKE patterns on a name; NULL names get the default."""
    low = F.coalesce(col(name), F.lit(""))
    out = F.lit(default)
    for label, patterns in reversed(list(rules.items())):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | low.like(p)
        out = F.when(hit, label).otherwise(out)
    return out


def era_key(*parts) -> Column:
    return F.concat_ws("_", *[col(p).cast("string") for p in parts])


def growth_score(temp_optimality, light_sufficiency) -> Column:
    return F.coalesce(col(temp_optimality) * F.least(col(light_sufficiency), F.lit(1.0)), F.lit(0.0))


def sustainability(growth, cost_efficiency, coupling) -> Column:
    return (0.4 * col(growth) + 0.3 * F.coalesce(col(cost_efficiency), F.lit(0.0))
            + 0.3 * F.coalesce(F.least(col(coupling), F.lit(1.0)), F.lit(0.0)))


def objective_triple(growth, cost_efficiency, stress_degree_days) -> dict[str, Column]:
    """Minimise energy cost, maximise growth, minimise stress."""
    return {"energy_cost": 1 - F.coalesce(col(cost_efficiency), F.lit(0.0)), "growth_rate": col(growth),
            "stress": 1 - F.least(F.coalesce(col(stress_degree_days), F.lit(0.0)), F.lit(1.0))}


def composite(weights: Mapping[str, float], maximise: frozenset[str] | set[str] = frozenset()) -> Column:
    """Weighted sum to minimise; maximised objectives enter with their sign flipped."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name) * (-w if name in maximise else w)
    return total


def constraints(bounds: Mapping[str, tuple[float | None, float | None]]) -> dict[str, Column]:
    """One boolean per bounded column plus ``feasible``."""
    out, ok = {}, F.lit(True)
    for name, (low, high) in bounds.items():
        c = F.lit(True)
        if low is not None:
            c = c & (F.col(name) >= low)
        if high is not None:
            c = c & (F.col(name) <= high)
        out[f"{name}_ok"] = F.coalesce(c, F.lit(False))
        ok = ok & out[f"{name}_ok"]
    out["feasible"] = ok
    return out


def to_resolution(c, low: float, high: float, step: float) -> Column:
    """Clip to bounds and round to a multiple of ``step``."""
    return F.round(clip(c, low, high) / step) * step


def solar_elevation(ts, latitude: float, longitude: float) -> Column:
    """Sine of the sun's elevation by the NOAA general solar position equations."""
    t = col(ts)
    hours = F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0
    year = 2 * math.pi / 365 * (F.dayofyear(t) - 1 + (hours - 12) / 24)
    eq_minutes = 229.18 * (0.000075 + 0.001868 * F.cos(year) - 0.032077 * F.sin(year)
                           - 0.014615 * F.cos(2 * year) - 0.040849 * F.sin(2 * year))
    decl = (0.006918 - 0.399912 * F.cos(year) + 0.070257 * F.sin(year) - 0.006758 * F.cos(2 * year)
            + 0.000907 * F.sin(2 * year) - 0.002697 * F.cos(3 * year) + 0.00148 * F.sin(3 * year))
    true_minutes = hours * 60 + eq_minutes + 4 * longitude
    angle = F.radians(true_minutes / 4 - 180)
    phi = math.radians(latitude)
    return math.sin(phi) * F.sin(decl) + math.cos(phi) * F.cos(decl) * F.cos(angle)


def clear_sky_irradiance(ts, latitude: float, longitude: float) -> Column:
    """Global horizontal irradiance of a cloudless sky (Haurwitz 1945), W/m², 0 at night."""
    s = solar_elevation(ts, latitude, longitude)
    return F.when(s > 0.001, 1098.0 * s * F.exp(F.lit(-0.057) / s)).otherwise(0.0)


def clear_sky_par(ts, latitude: float, longitude: float) -> Column:
    return clear_sky_irradiance(ts, latitude, longitude) * PAR_PER_WATT
