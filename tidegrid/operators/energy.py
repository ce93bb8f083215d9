"""Energy cost features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import Split, attach_row, cols, exact_quantiles, is_plain, match
from .stress import forward


def mark_peaks(df: DataFrame, price: str, keys, rule: str = "p75", hours: tuple[int, int] = (7, 23), ts: str = "hour",
               name: str = "is_peak", chunk="spread") -> DataFrame:
    """Peak rows by one rule: price above its ``p75`` or ``mean`` per key, or fixed ``hours`` of day."""
    k = cols(keys)
    if rule == "hours":
        h = F.hour(ts)
        return df.withColumn(name, (h >= hours[0]) & (h < hours[1]))
    if rule == "p75":
        limit = exact_quantiles(df, k, price, {"_limit": 0.75}, chunk=chunk)
    elif rule == "mean":
        limit = df.groupBy(*k).agg(F.avg(price).alias("_limit"))
    else:
        raise ValueError(f"unknown peak rule {rule}")
    both = df.transform(match, limit, k) if k else attach_row(df, limit)
    return both.withColumn(name, F.col(price) > F.col("_limit")).drop("_limit")


def price_of_area(prices: DataFrame, area: str | None, on="hour", price: str = "price") -> DataFrame:
    """Prices of one area, or the mean over areas."""
    chosen = prices if area is None else prices.where(F.col("area") == area)
    return chosen.groupBy(*cols(on)).agg(F.avg(price).alias(price))


def energy_features(df: DataFrame, power: str, price: str, peak: str, keys) -> DataFrame:
    """Cost-weighted use, peak ratios by sums and by means, energy per cost, shiftable saving."""
    p, c, hot = F.col(power), F.col(price), F.col(peak)
    g = df.groupBy(*cols(keys)).agg(
        F.sum(p * c).alias("cost_weighted"), F.sum(p).alias("_e"), F.avg(p).alias("_mean"), F.sum(F.when(hot, p)).alias("_ps"),
        F.sum(F.when(~hot, p)).alias("_os"), F.avg(F.when(hot, p)).alias("_pm"), F.avg(F.when(~hot, p)).alias("_om"))
    out = g.withColumns({
        "peak_ratio_sum": F.when(F.col("_os") > 0, F.coalesce(F.col("_ps"), F.lit(0.0)) / F.nullif(F.col("_os"), F.lit(0.0))).otherwise(999.0),
        "peak_ratio_mean": F.coalesce(F.col("_pm") / (F.col("_om") + 1e-8), F.lit(1.0)),
        "efficiency": F.coalesce(F.try_divide(F.col("_e"), F.col("cost_weighted")), F.lit(0.0)),
        "cost_per_degree_hour": F.col("cost_weighted") / 480})
    return out.select(*cols(keys), "cost_weighted", "peak_ratio_sum", "peak_ratio_mean", "efficiency", "cost_per_degree_hour")


def load_shift(df: DataFrame, power: str, price: str, keys, chunk="spread") -> DataFrame:
    """Saving from moving mean load into the cheapest quarter of the prices."""
    k = cols(keys)
    q = exact_quantiles(df, k, price, {"_q": 0.25}, chunk=chunk)
    stats = df.transform(match, q, k).groupBy(*k).agg(
        F.avg(price).alias("_p"), F.avg(F.when(F.col(price) <= F.col("_q"), F.col(price))).alias("_c"), F.avg(power).alias("_w"))
    return stats.select(*k, ((F.col("_p") - F.col("_c")) * F.col("_w")).alias("shift_saving"))


def hours_until_cheap(df: DataFrame, price: str, keys, ts: str = "hour", chunk="1 day") -> DataFrame:
    """Hours from each row to the next one priced below the first quartile; 0 when at or below it now."""
    from ..frames import epoch, next_valid, scan

    k = cols(keys)
    q = exact_quantiles(df, k, price, {"_q": 0.25}, chunk=chunk if is_plain(chunk) or isinstance(chunk, Split) else "spread")
    d = df.transform(match, q, k) if k else attach_row(df, q)
    cheap = F.when(F.col(price) < F.col("_q"), epoch(ts))
    d = scan(d, k, ts, {"_t": next_valid(cheap)}, chunk=chunk)
    wait = F.when(F.col(price) <= F.col("_q"), 0.0).otherwise((F.col("_t") - epoch(ts)) / 3600e6)
    return d.withColumn("hours_until_cheap", wait).drop("_q", "_t")


def cost_windows(df: DataFrame, n: int, keys, order="hour", *, energy: str, price: str, output: str, other: str, hour: Column,
                 peak: tuple[int, int] = (7, 23), chunk="1 day") -> DataFrame:
    """Price-weighted energy, output per cost, peak ratio by hours, time-of-use score and return, over one frame."""
    e, p = F.col(energy), F.col(price)
    hot = (hour >= peak[0]) & (hour < peak[1])

    def build(f):
        cost, total = F.sum(e * p).over(f), F.sum(e).over(f)
        lo, hi = total * F.min(p).over(f), total * F.max(p).over(f)
        on, off = (F.coalesce(F.sum(F.when(h, e)).over(f), F.lit(0.0)) for h in (hot, ~hot))
        made, spent = F.sum(output).over(f), cost + F.sum(other).over(f)
        return {"weighted_cost": cost,
                "cost_efficiency": F.when(cost > 0, made / F.nullif(cost, F.lit(0.0))).otherwise(0.0),
                "peak_ratio": F.when(off > 0, on / F.nullif(off, F.lit(0.0))).otherwise(on),
                "tou_score": F.when(hi > lo, 1 - (cost - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(1.0),
                "roi": F.when(spent > 0, (made - spent) / F.nullif(spent, F.lit(0.0))).otherwise(0.0)}

    return forward(df, n, keys, build, order, chunk=chunk)


def demand_response(price: str, flexibility: str, load: str, threshold: float) -> Column:
    over = F.col(price) - threshold
    return F.when(over > 0, over * F.col(flexibility) * F.col(load)).otherwise(0.0)


def carbon(energy: str, intensity: str) -> Column:
    return F.col(energy) * F.col(intensity)


def forecast_cost(forecast: str, actual: str, price: str, penalty: float) -> Column:
    """Cost of a forecast error: shortfalls pay price and penalty, surplus recovers half."""
    e = F.col(actual) - F.col(forecast)
    return F.when(e > 0, e * (F.col(price) + penalty)).otherwise(-e * F.col(price) * 0.5)


def peak_lamp_activity(df: DataFrame, lamps: list[str], peak: str, keys) -> DataFrame:
    """Mean over lamps of the share of known peak rows with the lamp on."""
    parts = [F.coalesce(F.avg(F.when(F.col(peak), (F.col(c) > 0.5).cast("int"))), F.lit(0.0)) for c in lamps]
    return df.groupBy(*cols(keys)).agg((sum(parts[1:], parts[0]) / len(lamps)).alias("peak_activity"))


def economic_impact(scored: DataFrame, history: DataFrame, energy: str, growth: str, keys=(), price: float = 0.25, value: float = 2.5,
                    days: int = 365) -> DataFrame:
    """Annual cost and production of solutions against the historical means."""
    base = history.agg(F.avg(energy).alias("_he"), F.avg(growth).alias("_hg"))
    g = attach_row(scored.groupBy(*cols(keys)).agg(F.avg(energy).alias("_e"), F.avg(growth).alias("_g")), base)
    cost, made = F.col("_e") * days * price, F.col("_g") * days * value
    base_cost = F.col("_he") * days * price
    saved, more = base_cost - cost, made - F.col("_hg") * days * value
    return g.select(*cols(keys), cost.alias("annual_energy_cost"), made.alias("annual_production_value"), saved.alias("energy_cost_savings"),
                    more.alias("production_value_increase"), (saved + more).alias("net_benefit"),
                    F.coalesce(F.try_divide((saved + more) * 100, base_cost), F.lit(0.0)).alias("roi_percent"))
