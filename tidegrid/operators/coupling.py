"""Inside/outside coupling of climate series on a grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import carried, cols, following, is_plain, prev, row_frames, scan
from ..functions.stats import corr
from .stress import forward


def weather_coupling(df: DataFrame, inside: str, outside: str, solar: str, keys) -> DataFrame:
    """Differential, solar efficiency, thermal-mass and ventilation indicators per group."""
    d, s = F.col(inside) - F.col(outside), F.col(solar)
    g = df.groupBy(*cols(keys)).agg(
        F.avg(d).alias("temp_diff_mean"), F.stddev(d).alias("temp_diff_std"),
        F.coalesce(F.avg(F.when(s > 0, d / F.nullif(s, F.lit(0.0)))), F.lit(0.0)).alias("solar_efficiency"),
        F.coalesce(F.try_divide(F.sum(F.greatest(d, F.lit(0.0))), F.sum(s)), F.lit(0.0)).alias("solar_gain"),
        F.stddev(outside).alias("_o"))
    return g.withColumns({"thermal_mass": F.col("temp_diff_std") / (F.col("_o") + 1e-8),
                          "ventilation": 1 / (1 + F.col("temp_diff_std"))}).drop("_o")


def best_lag(df: DataFrame, lead: str, follow: str, max_lag: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Lag (rows) at which ``follow`` correlates best with ``lead`` over the whole series."""
    d = row_frames(df, keys, order, 0, max_lag, lambda w: {f"_y{k}": F.lead(follow, k).over(w) for k in range(max_lag + 1)}, chunk=chunk)
    g = d.groupBy(*cols(keys)).agg(*[corr(lead, f"_y{k}").alias(f"_r{k}") for k in range(max_lag + 1)])
    return _pick_lag(g, max_lag, cols(keys))


def _best(values: list[Column]) -> Column:
    pairs = F.array(*[F.struct(F.coalesce(c, F.lit(-1.0)).alias("corr"), F.lit(-k).alias("neg")) for k, c in enumerate(values)])
    return F.array_max(pairs)


def _pick_lag(df: DataFrame, max_lag: int, keep) -> DataFrame:
    best = _best([F.col(f"_r{k}") for k in range(max_lag + 1)])
    return df.withColumn("_b", best).select(*keep, (-F.col("_b.neg")).alias("lag"), F.col("_b.corr").alias("corr"))


def rolling_lag(df: DataFrame, lead: str, follow: str, max_lag: int, n: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Best lag of ``follow`` behind ``lead`` in each forward window of ``n`` rows.

    Where no series is split, each is read once against the order, and only the rows that the next windows need are handed on.
    """
    lags = range(max_lag + 1)
    if is_plain(chunk):
        x, y = F.col(lead).cast("double"), F.col(follow).cast("double")
        given = {"_x": x, "_y": y, "_hx": x.isNotNull(), "_hy": y.isNotNull()}
        made = ", ".join(f"_r{k} double" for k in lags) + ", _c long"
        out = carried(df.withColumns(given), keys, order, list(given), made, lambda: LagWindows(max_lag, n), back=True)
        best = F.when(F.col("_c") == n, _best([F.col(f"_r{k}") for k in lags]))
        return out.withColumn("_b", best).select(*df.columns, (-F.col("_b.neg")).alias("lag"), F.col("_b.corr").alias("corr"))
    d = row_frames(df, keys, order, 0, max_lag, lambda w: {f"_y{k}": F.lead(follow, k).over(w) for k in lags}, chunk=chunk)

    def build(w):
        frame = w.rowsBetween(0, n - 1)
        out = {f"_r{k}": corr(lead, f"_y{k}", frame) for k in lags}
        return {**out, "_c": F.count(f"_y{max_lag}").over(frame)}

    out = row_frames(d, keys, order, 0, n - 1, build, chunk=chunk)
    best = F.when(F.col("_c") == n, _best([F.col(f"_r{k}") for k in lags]))
    return out.withColumn("_b", best).select(*df.columns, (-F.col("_b.neg")).alias("lag"), F.col("_b.corr").alias("corr"))


class LagWindows:
    """Correlations of x with y some rows later in the window of ``n`` rows from each row on, of rows that come against the order.

    -1 where either is constant or no pair is whole; last comes the number of rows of the window that have a y ``most`` rows later.
    """

    def __init__(self, most: int, n: int, flat: float = 1e-9):
        self.most, self.n, self.flat = most, n, flat
        none = np.zeros(n - 1 + most)
        self.after = [none, none, none.astype(bool), none.astype(bool)]  # x, y and whether there is one, of the next rows

    def __call__(self, *given):
        m, n = len(given[0]), self.n
        rows = [np.concatenate([np.asarray(now, after.dtype)[::-1], after]) for now, after in zip(given, self.after)]
        self.after = [r[:n - 1 + self.most] for r in rows]
        x, y, has_x, has_y = rows
        wide = m + n - 1
        out = [self.corr(x[:wide], y[k:k + wide], has_x[:wide] & has_y[k:k + wide])[::-1] for k in range(self.most + 1)]
        later = has_y[self.most:self.most + wide]
        return *out, np.lib.stride_tricks.sliding_window_view(later, n).sum(axis=1)[::-1]

    def corr(self, x: np.ndarray, y: np.ndarray, whole: np.ndarray) -> np.ndarray:
        def windows(a):
            return np.lib.stride_tricks.sliding_window_view(a, self.n)

        use = windows(whole)
        count = np.maximum(use.sum(axis=1), 1)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            dx, dy = (np.where(use, w - (w.sum(axis=1) / count)[:, None], 0.0) for w in (windows(np.where(whole, x, 0.0)), windows(np.where(whole, y, 0.0))))
            spread = np.sqrt((dx * dx).sum(axis=1) / count) * np.sqrt((dy * dy).sum(axis=1) / count)
            return np.where(spread <= self.flat, -1.0, (dx * dy).sum(axis=1) / count / spread)


def thermal_slope(df: DataFrame, inside: str, outside: str, power: str, n: int, keys, order="ts", min_diff: float = 0.5,
                  min_points: int = 10, chunk="1 day") -> DataFrame:
    """Heating power per degree of difference: regression over each forward window, 0 with too few points."""
    d = F.col(inside) - F.col(outside)
    use = F.abs(d) > min_diff
    x, y = F.when(use, d), F.when(use, F.col(power))

    def build(f):
        return {"slope": F.when(F.count(x).over(f) > min_points, F.regr_slope(y, x).over(f)).otherwise(0.0)}

    return forward(df, n, keys, build, order, chunk=chunk)


def radiation_gain(df: DataFrame, radiation: str, inside: str, area: float, thermal_mass: float, keys, order="ts", step_h: float = 1.0,
                   chunk="1 day") -> DataFrame:
    """Share of the available solar energy that warmed the air until the next row, at most 1."""
    out = scan(df, keys, order, {"_n": following(inside)}, chunk=chunk)
    rise, r = F.col("_n") - F.col(inside), F.col(radiation)
    gain = F.when((r > 50) & (rise > 0), F.least(thermal_mass * rise / (r * area * step_h * 3.6), F.lit(1.0))).otherwise(0.0)
    return out.withColumn("radiation_gain", F.when(F.col("_n").isNotNull(), gain)).drop("_n")


def shgc(radiation: str, rise: str, shading: str, thermal_mass: float, glazing: float) -> Column:
    """Dynamic solar heat gain coefficient (at most 0.87, dimmed by shading)."""
    shade = 1 - 0.8 * F.col(shading) / 100
    seen = F.least(thermal_mass * F.col(rise) / (F.col(radiation) * glazing * 3.6), F.lit(0.87))
    return F.when((F.col(radiation) > 100) & (F.col(rise) > 0), seen).otherwise(0.4) * shade


def humidity_influx(inside: str, outside: str, vent: str, wind: str, vent_area: float, volume: float) -> Column:
    changes = F.col(vent) / 100 * vent_area * (0.5 + 0.5 * F.sqrt(F.col(wind))) / volume
    return (F.col(outside) - F.col(inside)) * changes


def infiltration(inside: str, outside: str, wind: str, pressure: str, vent: str, height: float) -> Column:
    """Air changes per hour by stack, wind and pressure through closed vents."""
    i, o = F.col(inside), F.col(outside)
    stack = F.sqrt(height * F.abs(i - o) / ((i + o) / 2 + 273.15)) * 0.15
    return (1 - F.col(vent) / 100) * (stack + 0.05 * F.sqrt(F.col(wind)) + 0.02 * F.sqrt(F.abs(F.col(pressure))))


def vent_efficacy(df: DataFrame, inside: str, outside: str, production: str, vent: str, n: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """Observed over theoretical CO2 decay while vents are open, at most 1, over each forward window's steps."""
    d = scan(df, keys, order, {"_p": prev(inside)}, chunk=chunk)
    v = F.col(vent) / 100
    theory = v * (F.col("_p") - F.col(outside)) * 0.8
    use = (v > 0.1) & (theory > 0)
    actual = F.greatest(F.col("_p") + F.col(production) - F.col(inside), F.lit(0.0))
    d = d.withColumns({"_t": F.when(use, theory), "_a": F.when(use, actual)})

    def build(w):
        steps = w.rowsBetween(1, n - 1)  # the first row has no step inside the window
        t = F.sum("_t").over(steps)
        share = F.when(t > 0, F.least(F.sum("_a").over(steps) / t, F.lit(1.0))).otherwise(0.0)
        return {"efficacy": F.when(F.count(F.lit(1)).over(w.rowsBetween(0, n - 1)) == n, share)}

    return row_frames(d, keys, order, 0, n - 1, build, chunk=chunk).drop("_p", "_t", "_a")


def u_value(df: DataFrame, inside: str, outside: str, heating_kw: str, solar: str, area: float, glazing: float, n: int, keys, order="ts",
            default: float = 3.0, chunk="1 day") -> DataFrame:
    """Heat-loss coefficient from dark rows with a clear difference; a default with too few of them."""
    d = F.col(inside) - F.col(outside)
    use = (F.col(solar) * glazing * 0.7 < 50) & (F.abs(d) > 2)
    loss, span = F.when(use, F.col(heating_kw) * 1000), F.when(use, d * area)

    def build(f):
        ok = (F.count(span).over(f) > 5) & (F.sum(span).over(f) > 0)
        return {"u_value": F.when(ok, F.sum(loss).over(f) / F.nullif(F.sum(span).over(f), F.lit(0.0))).otherwise(default)}

    return forward(df, n, keys, build, order, chunk=chunk)


def simple_coupling(df: DataFrame, light: str, temp: str, co2: str, keys, lag: int = 60, order="ts", chunk="1 day") -> DataFrame:
    """Light-temperature correlation, CO2-temperature covariance, thermal inertia."""
    d = row_frames(df, keys, order, lag, 0, lambda w: {"_l": F.lag(temp, lag).over(w)}, chunk=chunk)
    return d.groupBy(*cols(keys)).agg(
        F.coalesce(corr(light, temp), F.lit(0.0)).alias("light_temp"), F.covar_pop(co2, temp).alias("co2_temp"),
        (1 / (1 + F.coalesce(F.max(F.abs(F.col(temp) - F.col("_l")) / lag), F.lit(0.0)))).alias("thermal_inertia"))
