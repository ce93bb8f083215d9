"""Light, thermal time and growth features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cols, epoch, following, match, prev, running_sum, scan
from ..functions.calendar import trunc


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def at_least_zero(c: Column) -> Column:
    """max(c, 0) that keeps NULL."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def dli(df: DataFrame, ppfd: str, keys, ts: str = "ts", chunk="1 day") -> DataFrame:
    """Daily light integral: each reading holds for the seconds since the previous one."""
    t = epoch(ts)
    d = scan(df, keys, ts, {"_p": prev(t)}, chunk=chunk)
    mol = F.coalesce(F.greatest(F.col(ppfd).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.coalesce((t - F.col("_p")) / 1e6, F.lit(0.0)) / 1e6
    return d.groupBy(*cols(keys), trunc("day", ts).alias("day")).agg(F.sum(mol).alias("dli"))


def gdd_daily(df: DataFrame, temp: str, keys, base: float = 10.0, cap: float | None = None, ts: str = "ts") -> DataFrame:
    """Growing degree days from daily extremes clamped to [base, cap], and their running sum over days."""
    k = cols(keys)
    day = df.groupBy(*k, trunc("day", ts).alias("day")).agg(F.min(temp).alias("_lo"), F.max(temp).alias("_hi")).dropna()
    b = F.lit(float(base))
    hi = F.col("_hi") if cap is None else F.least(F.col("_hi"), F.lit(float(cap)))
    hi, lo = F.greatest(hi, b), F.greatest(F.col("_lo"), b)
    daily = day.select(*k, "day", F.greatest((hi + F.least(lo, hi)) / 2 - b, F.lit(0.0)).alias("gdd_daily"))
    # one row per day: bounded by the span
    return scan(daily, k, "day", {"gdd_cumulative": running_sum("gdd_daily")}, chunk=None)


def gdd(df: DataFrame, temp: str, keys, method: str, base: float = 10.0, cap: float = 35.0, ts: str = "ts") -> DataFrame:
    """Growing degree days per group: ``hourly`` sum / 24, ``clamped`` rows / 24, or ``daily`` means above base."""
    k, x = cols(keys), F.col(temp)
    if method == "hourly":
        return df.groupBy(*k).agg((F.sum(at_least_zero(x - base)) / 24).alias("gdd"))
    if method == "clamped":
        return df.groupBy(*k).agg((F.sum(at_least_zero(F.least(x, F.lit(float(cap))) - base)) / 24).alias("gdd"))
    day = df.groupBy(*k, trunc("day", ts).alias("_d")).agg(F.avg(x).alias("_m"))
    return day.groupBy(*k).agg(F.sum(F.greatest(F.coalesce(F.col("_m"), F.lit(float(base))) - base, F.lit(0.0))).alias("gdd"))


def dif(df: DataFrame, temp: str, is_day: Column, keys, ts: str = "ts") -> DataFrame:
    """Mean day minus mean night temperature per date."""
    x = F.col(temp)
    return df.groupBy(*cols(keys), trunc("day", ts).alias("day")).agg(
        (F.avg(F.when(is_day, x)) - F.avg(F.when(~is_day, x))).alias("dif"))


def photoperiod(df: DataFrame, keys, light: str | None = None, lamp: str | None = None, threshold: float = 50.0,
                ts: str = "ts") -> DataFrame:
    """Lit hours per date on an hourly grid: lamp on, or light above the threshold."""
    lit = F.col(lamp) > 0 if lamp else F.col(light) > threshold
    return df.groupBy(*cols(keys), trunc("day", ts).alias("day")).agg(F.count_if(lit).alias("photoperiod_hours"))


def growth_features(df: DataFrame, temp: str, light: str, lit: str, keys, *, base: float = 10.0, day_opt: float = 22.0,
                    night_opt: float = 18.0, need: float = 150.0) -> DataFrame:
    """Growth features of an hourly window; day is where light is present."""
    t, li, day = F.col(temp), F.col(light), F.col(light) > 0

    def near(opt: float, cls: Column) -> Column:
        return F.coalesce(F.avg(F.when(cls, clamp01(1 - F.abs(t - opt) / 10))), F.lit(0.0))

    g = df.groupBy(*cols(keys)).agg(
        (F.sum(at_least_zero(t - base)) / 24).alias("gdd"), (F.sum(li) * 3600 / 1e6).alias("dli"),
        F.sum(lit).cast("double").alias("photoperiod_hours"), near(day_opt, day).alias("_d"), near(night_opt, ~day).alias("_n"),
        F.avg(clamp01(li / need)).alias("light_sufficiency"),
        ((F.sum(at_least_zero(t - 30)) + F.sum(at_least_zero(5 - t))) / 24).alias("stress_degree_days"))
    g = g.withColumn("temperature_optimality", (F.col("_d") + F.col("_n")) / 2).drop("_d", "_n")
    hours = F.col("photoperiod_hours")
    return g.withColumns({
        "flowering_signal": F.when(hours < 10, 1.0).when(hours > 14, 0.0).otherwise(0.5),
        "expected_growth": F.col("temperature_optimality") * F.col("light_sufficiency") * (1 - F.col("stress_degree_days") / 10)})


def trait_growth(df: DataFrame, temp: str, light: str, keys, *, base: float = 10.0, day_opt: float = 22.0, night_opt: float = 18.0,
                 dli_need: float = 12.0, short_day: float = 8.0) -> DataFrame:
    """Growth features against a plant's traits (optima, light need, flowering day length)."""
    t, li = F.col(temp), F.col(light)
    outside = (t < night_opt - 2) | (t > day_opt + 2)
    g = df.groupBy(*cols(keys)).agg(
        (F.sum(at_least_zero(t - base)) / 24).alias("gdd"), F.avg(clamp01(1 - F.abs(t - day_opt) / 10)).alias("temperature_optimality"),
        (F.sum(F.when(outside, F.abs(t - day_opt)).otherwise(0.0)) / 24).alias("stress_degree_days"),
        (F.sum(li) * 3600 / 1e6 / 24).alias("dli"), F.count_if(li > 50).cast("double").alias("photoperiod_hours"))
    return g.withColumns({"light_sufficiency": F.col("dli") / dli_need,
                          "flowering_signal": F.when(F.col("photoperiod_hours") <= short_day, 1.0).otherwise(0.0)})


def photothermal(temp, light, base: float, opt: float, top: float, light_full: float) -> Column:
    """Triangular temperature response times saturating light response."""
    t = F.col(temp)
    rise, fall = (t - base) / (opt - base), (top - t) / (top - opt)
    heat = F.when((t > base) & (t < top), F.when(t <= opt, rise).otherwise(fall)).otherwise(0.0)
    return heat * F.least(F.lit(1.0), F.col(light) / light_full)


def cumulative_indices(df: DataFrame, keys, order="ts", *, vpd: str | None = None, ppfd: str | None = None, vpd_limit: float = 1.2,
                       step_s: float = 3600.0, chunk="1 day") -> DataFrame:
    """Running VPD excess and running light integral in one scan."""
    specs = {}
    if vpd:
        specs["cvpi"] = running_sum(F.coalesce(at_least_zero(F.col(vpd) - vpd_limit), F.lit(0.0)))
    if ppfd:
        specs["ali"] = running_sum(F.coalesce(F.col(ppfd), F.lit(0.0)) * step_s * 1e-6)
    return scan(df, keys, order, specs, chunk=chunk)


def heat_stress_hours(temp, critical: float, step_h: float = 1.0) -> Column:
    return F.when(F.col(temp) > critical, step_h).otherwise(0.0)


def thermal_efficiency(temp, low: float, opt_low: float, opt_high: float, high: float) -> Column:
    """Trapezoid: 0 outside [low, high], 1 inside the optimum, linear between."""
    t = F.col(temp)
    return (F.when(t.between(opt_low, opt_high), 1.0).when((t >= low) & (t < opt_low), (t - low) / (opt_low - low))
            .when((t > opt_high) & (t <= high), (high - t) / (high - opt_high)).otherwise(0.0))


def degree_hours(temp, heating_base: float = 18.0, cooling_base: float = 24.0) -> dict[str, Column]:
    t = F.col(temp)
    return {"heating": at_least_zero(heating_base - t), "cooling": at_least_zero(t - cooling_base)}


def total_integral(df: DataFrame, value: str, keys, unit: float = 1.0, ts: str = "ts", chunk="1 day") -> DataFrame:
    """Sum of value x elapsed seconds x unit; the first reading uses the first interval."""
    t = epoch(ts)
    d = scan(df, keys, ts, {"_p": prev(t), "_n": following(t)}, chunk=chunk)
    secs = F.coalesce(t - F.col("_p"), F.col("_n") - t) / 1e6
    return d.groupBy(*cols(keys)).agg((F.sum(F.col(value) * secs) * unit).alias("integral"))


def setpoint_scores(df: DataFrame, value: str, setpoint: Column, keys, low: float, high: float) -> DataFrame:
    """Mean absolute deviation from the set-point and share of readings in range (percent)."""
    x = F.col(value)
    return df.groupBy(*cols(keys)).agg(F.avg(F.abs(x - setpoint)).alias("mad"),
                                       (F.avg(x.between(low, high).cast("int")) * 100).alias("in_range_pct"))


def scaled_par(df: DataFrame, clear_par: str, keys, *, dli: str | None = None, radiation: str | None = None, clear_ghi: str | None = None,
               step_s: float = 300.0, low: float = 0.25, high: float = 4.0, ts: str = "ts") -> DataFrame:
    """Synthetic PAR: clear-sky PAR scaled per day to the observed light integral, dimmed by measured radiation."""
    k, par = cols(keys), F.col(clear_par)
    out = df
    if dli:
        day = df.groupBy(*k, trunc("day", ts).alias("_day")).agg((F.sum(par) * step_s / 1e6).alias("_syn"), F.max(dli).alias("_obs"))
        ratio = F.least(F.greatest(F.col("_obs") / F.nullif(F.col("_syn"), F.lit(0.0)), F.lit(low)), F.lit(high))
        scale = day.select(*k, "_day", F.when(F.col("_obs").isNull(), 1.0).otherwise(F.coalesce(ratio, F.lit(1.0))).alias("_scale"))
        out = out.withColumn("_day", trunc("day", ts)).transform(match, scale, [*k, "_day"], "left").drop("_day")
        par = par * F.col("_scale")
    if radiation:
        kt = clamp01(F.col(radiation) / F.nullif(F.col(clear_ghi), F.lit(0.0)))
        par = par * F.coalesce(kt, F.lit(1.0))
    return out.withColumn("par", par).drop("_scale")


def training_targets(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Energy and growth targets from feature means (without a random term); missing features take defaults."""
    have = {k: F.col(c) for k, c in names.items() if c in df.columns}

    def get(k: str, default: float) -> Column:
        return F.coalesce(have[k], F.lit(default))

    energy, growth = F.lit(0.0), F.lit(1.0)
    if {"temp", "setpoint"} <= have.keys():
        energy = energy + F.greatest(F.lit(0.0), (get("setpoint", 20.0) - get("temp", 18.0)) * 2)
    if "light" in have:
        energy = energy + get("light", 0.0) * 0.01
        growth = growth * F.least(F.lit(1.0), get("light", 100.0) / 200)
    if "co2" in have:
        energy = energy + F.greatest(F.lit(0.0), get("co2", 400.0) - 800) * 0.005
    if "temp" in have:
        growth = growth * F.greatest(F.lit(0.3), 1 - F.abs(get("temp", 20.0) - 22) * 0.05)
    if "rh" in have:
        growth = growth * F.greatest(F.lit(0.5), 1 - F.abs(get("rh", 60.0) - 60) * 0.01)
    if "vpd" in have:
        x = get("vpd", 0.8)
        growth = growth * F.when(x.between(0.8, 1.2), 1.0).otherwise(F.greatest(F.lit(0.6), 1 - F.abs(x - 1) * 0.2))
    return df.withColumns({"energy_target": F.greatest(F.lit(0.0), energy), "growth_target": F.greatest(F.lit(0.0), growth)})

