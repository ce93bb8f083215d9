"""Rolling, cumulative, sliding windows."""

from pyspark.sql import functions as F

from ...operators import grid as og
from ...operators import rolling as ro
from ...operators import sparse as sp
from ..registry import query
from .grid import DENSE, dense

W = "PARTITION BY signal ORDER BY ts"


@query("W-05,W-06", "rolling_time", views="readings_n", r="value_mean value_std",
       sql="""SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS value_mean, CASE WHEN count(value) OVER w >= 3 THEN stddev(value) OVER w END AS value_std
       FROM readings_n WINDOW w AS (PARTITION BY signal ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING)""")
def _(v):
    return ro.rolling(v.readings_n.select("event_id", "signal", "ts", "value"), "value", "6h", ["mean", "std"], "signal", min_n=3).select("event_id", "value_mean", "value_std")


@query("W-05,W-06", "rolling_time_right", views="readings_n", r="value_mean value_q50",
       sql="""SELECT event_id, CASE WHEN count(value) OVER w >= 1 THEN avg(value) OVER w END AS value_mean, CASE WHEN count(value) OVER w >= 1 THEN quantile_cont(value, 0.5) OVER w END AS value_q50
       FROM readings_n WINDOW w AS (PARTITION BY entity ORDER BY epoch_us(ts) RANGE BETWEEN 172799999999 PRECEDING AND CURRENT ROW)""")
def _(v):
    return ro.rolling(v.readings_n, "value", "48h", ["mean", "q50"], "entity", closed="right").select("event_id", "value_mean", "value_q50")


SIMPLE = ("mean", "std", "min", "max", "median", "var", "sum", "kurt", "q25", "q50", "q75")
DUCK = {"mean": "avg(value)", "std": "stddev(value)", "min": "min(value)", "max": "max(value)", "median": "quantile_cont(value, 0.5)", "var": "variance(value)",
        "sum": "sum(value)", "kurt": "kurtosis_pop(value)", "q10": "quantile_cont(value, 0.1)", "q25": "quantile_cont(value, 0.25)", "q50": "quantile_cont(value, 0.5)",
        "q75": "quantile_cont(value, 0.75)", "q90": "quantile_cont(value, 0.9)"}


@query("W-07", "rolling_rows", views="readings", r=" ".join(f"value_{s}" for s in SIMPLE), digits=4,
       sql="SELECT event_id, " + ", ".join(f"CASE WHEN count(value) OVER w >= 10 THEN {DUCK[s]} OVER w END AS value_{s}" for s in SIMPLE)
       + f" FROM readings WINDOW w AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def _(v):
    return ro.rolling_rows(v.readings, "value", 12, SIMPLE, "signal", min_n=10, chunk=v.split("signal")).select("event_id", *[f"value_{s}" for s in SIMPLE])


@query("W-10", "rolling_quantiles", views="readings", r="value_q10 value_q25 value_q50 value_q75 value_q90",
       sql="SELECT event_id, " + ", ".join(f"{DUCK[s]} OVER w AS value_{s}" for s in ("q10", "q25", "q50", "q75", "q90"))
       + f" FROM readings WINDOW w AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
def _(v):
    s = ("q10", "q25", "q50", "q75", "q90")
    return ro.rolling_rows(v.readings, "value", 24, s, "signal", chunk=v.split("signal")).select("event_id", *[f"value_{x}" for x in s])


SKEW = ("CASE WHEN count(value) OVER w >= 6 THEN (avg(value*value*value) OVER w - 3 * avg(value) OVER w * avg(value*value) OVER w + 2 * pow(avg(value) OVER w, 3)) / pow(var_pop(value) OVER w, 1.5) END")


@query("W-11,W-07", "rolling_shape", views="readings", r="value_range value_skew value_kurt value_cv", digits=4,
       sql=f"""SELECT event_id, CASE WHEN count(value) OVER w >= 6 THEN max(value) OVER w - min(value) OVER w END AS value_range, {SKEW} AS value_skew,
       CASE WHEN count(value) OVER w >= 6 THEN kurtosis_pop(value) OVER w END AS value_kurt,
       CASE WHEN count(value) OVER w >= 6 THEN stddev_pop(value) OVER w / nullif(abs(avg(value) OVER w), 0) END AS value_cv
       FROM readings WINDOW w AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def _(v):
    s = ("range", "skew", "kurt", "cv")
    return ro.rolling_rows(v.readings, "value", 24, s, "signal", min_n=6, chunk=v.split("signal")).select("event_id", *[f"value_{x}" for x in s])


@query("W-12", "rolling_robust", views="readings", r="value_iqr value_mad",
       sql=f"""SELECT event_id, quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w AS value_iqr, mad(value) OVER w AS value_mad
       FROM readings WINDOW w AS ({W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def _(v):
    return ro.rolling_rows(v.readings, "value", 15, ("iqr", "mad"), "signal", chunk=v.split("signal")).select("event_id", "value_iqr", "value_mad")


@query("W-10,W-12", "rolling_long_frames", views="readings_n", r="value_q10 value_median value_iqr value_mad value_mean", digits=5,
       sql=f"""SELECT event_id, quantile_cont(value, 0.1) OVER w AS value_q10, median(value) OVER w AS value_median, quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w AS value_iqr,
       mad(value) OVER w AS value_mad, avg(value) OVER w AS value_mean FROM readings_n WINDOW w AS ({W} ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""")
def _(v):
    s = ("q10", "median", "iqr", "mad", "mean")
    return ro.rolling_rows(v.readings_n.select("event_id", "signal", "ts", "value"), "value", 1000, s, "signal", chunk=v.split("signal", of="readings_n")).select("event_id", *[f"value_{x}" for x in s])


@query("W-13", "rolling_z", views="readings", r="value_z", digits=5,
       sql=f"""SELECT event_id, CASE WHEN stddev_pop(value) OVER w <= 1e-10 THEN 0 ELSE (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) END AS value_z
       FROM readings WINDOW w AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def _(v):
    return ro.rolling_rows(v.readings, "value", 24, ("z",), "signal", chunk=v.split("signal")).select("event_id", "value_z")


@query("W-14", "rolling_means", views="readings", r="value_gmean value_hmean", digits=5,
       sql=f"""SELECT event_id, exp(avg(CASE WHEN value > 0 THEN ln(value) END) OVER w) AS value_gmean,
       count(CASE WHEN value <> 0 THEN value END) OVER w / sum(CASE WHEN value <> 0 THEN 1 / value END) OVER w AS value_hmean
       FROM readings WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(v):
    return ro.rolling_rows(v.readings, "value", 10, ("gmean", "hmean"), "signal", chunk=v.split("signal")).select("event_id", "value_gmean", "value_hmean")


@query("W-08", "rolling_stride", views="readings", sql=f"SELECT event_id FROM (SELECT event_id, row_number() OVER ({W}) AS n FROM readings) WHERE (n - 1) % 15 = 0")
def _(v):
    return ro.stride(v.readings, 15, "signal", chunk=v.split("signal")).select("event_id")


@query("W-09,D-22", "rolling_abs_diff", views="readings", r="abs_diff",
       sql=f"""SELECT event_id, sum(s) OVER ({W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS abs_diff FROM (SELECT *, abs(value - lag(value) OVER ({W})) AS s FROM readings)""")
def _(v):
    return ro.rolling_abs_diff(v.readings, "value", 10, "signal", chunk=v.split("signal")).select("event_id", "abs_diff")


@query("W-15", "rolling_ewma", views="readings", r="ewma",
       sql="""WITH RECURSIVE o AS (SELECT event_id, signal, value, row_number() OVER (PARTITION BY signal ORDER BY ts) AS n FROM readings),
       r(signal, n, y) AS (SELECT signal, n, value FROM o WHERE n = 1 UNION ALL SELECT o.signal, o.n, 0.7 * r.y + 0.3 * o.value FROM r JOIN o ON o.signal = r.signal AND o.n = r.n + 1)
       SELECT event_id, y AS ewma FROM o JOIN r USING (signal, n)""".replace("WITH RECURSIVE ", "WITH "))
def _(v):
    return ro.ewma(v.readings, "value", 0.3, "signal", chunk=v.split("signal")).select("event_id", "ewma")


@query("W-16", "rolling_holt", views="readings", r="level trend",
       sql="""WITH o AS (SELECT event_id, signal, value, row_number() OVER (PARTITION BY signal ORDER BY ts) AS n FROM readings),
       r(signal, n, l, t) AS (SELECT signal, n, value, 0.0::DOUBLE FROM o WHERE n = 1 UNION ALL SELECT o.signal, o.n, 0.4 * o.value + 0.6 * (r.l + r.t),
         0.3 * (0.4 * o.value + 0.6 * (r.l + r.t) - r.l) + 0.7 * r.t FROM r JOIN o ON o.signal = r.signal AND o.n = r.n + 1)
       SELECT event_id, l AS level, t AS trend FROM o JOIN r USING (signal, n)""")
def _(v):
    return ro.holt(v.readings, "value", 0.4, 0.3, "signal", chunk=v.split("signal")).select("event_id", "level", "trend")


@query("W-17,W-18", "rolling_cumulative", views="readings", r="total growth", digits=5,
       sql=f"""SELECT event_id, sum(value) OVER w AS total, product(1 + value / 100000) OVER w AS growth FROM readings WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)""")
def _(v):
    return ro.cumulative(v.readings, {"total": ("sum", "value"), "growth": ("product", 1 + F.col("value") / 100000)}, "signal", chunk=v.split("signal")).select("event_id", "total", "growth")


@query("W-19", "rolling_lag_time", views="grid", r="value_lag_24h",
       sql="SELECT g.signal, g.ts, p.value AS value_lag_24h FROM grid g LEFT JOIN grid p ON g.signal = p.signal AND g.ts = p.ts + INTERVAL 24 HOUR")
def _(v):
    return ro.lag_time(v.grid, "value", "24h", "signal").select("signal", "ts", "value_lag_24h")


@query("W-20", "rolling_rate", views="readings", r="value_delta value_rate",
       sql=f"""SELECT event_id, value - lag(value) OVER w AS value_delta, (value - lag(value) OVER w) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0) AS value_rate
       FROM readings WINDOW w AS ({W})""")
def _(v):
    return ro.rate_of_change(v.readings, "value", "signal", chunk=v.split("signal")).select("event_id", "value_delta", "value_rate")


@query("W-21", "rolling_gradient", views="readings", r="gradient",
       sql=f"""SELECT event_id, coalesce((lead(value) OVER w - lag(value) OVER w) / 2, lead(value) OVER w - value, value - lag(value) OVER w) AS gradient FROM readings WINDOW w AS ({W})""")
def _(v):
    return ro.gradient(v.readings, "value", "signal", chunk=v.split("signal")).select("event_id", "gradient")


@query("W-23", "rolling_volatility", views="grid", r="vol_1d vol_7d",
       sql=f"""SELECT signal, ts, CASE WHEN count(value) OVER d = 24 THEN stddev(value) OVER d END AS vol_1d, CASE WHEN count(value) OVER k = 168 THEN stddev(value) OVER k END AS vol_7d
       FROM grid WINDOW d AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), k AS ({W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""")
def _(v):
    return ro.volatility(v.grid, "value", {"vol_1d": 24, "vol_7d": 168}, "signal", chunk=None).select("signal", "ts", "vol_1d", "vol_7d")


@query("W-24", "rolling_summary", views="readings", r="mean_of_means max_std", i="blocks",
       sql="""SELECT entity, avg(m) AS mean_of_means, max(s) AS max_std, count(*) AS blocks FROM (SELECT entity, time_bucket(INTERVAL 1 DAY, ts) AS b, avg(value) AS m, stddev(value) AS s FROM readings GROUP BY ALL) GROUP BY entity""")
def _(v):
    return ro.rolling_summary(v.readings, "value", "1 day", "entity")


@query("W-25", "rolling_price_features", views="price", r="price price_lag_1h price_lag_24h price_yesterday deviation",
       sql="""SELECT p.hour, p.price, a.price AS price_lag_1h, b.price AS price_lag_24h, y.m AS price_yesterday, p.price - avg(p.price) OVER (PARTITION BY date_trunc('month', p.hour)) AS deviation,
       month(p.hour) IN (12, 1, 2) AS is_winter, p.price > (SELECT quantile_cont(price, 0.75) FROM price) AS is_peak
       FROM price p LEFT JOIN price a ON a.hour + INTERVAL 1 HOUR = p.hour LEFT JOIN price b ON b.hour + INTERVAL 24 HOUR = p.hour
       LEFT JOIN (SELECT date_trunc('day', hour) + INTERVAL 1 DAY AS d, avg(price) AS m FROM price GROUP BY 1) y ON y.d = date_trunc('day', p.hour)""")
def _(v):
    return ro.price_features(v.price, "price", chunk=None)


def _decompose_sql(op):
    bare = "value - trend" if op == "-" else "value / trend"
    seas = "s - c" if op == "-" else "s / c"
    resid = f"bare {op} ({seas})"
    return f"""WITH {DENSE}, f AS (SELECT signal, ts, last_value(value IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS value, row_number() OVER ({W}) - 1 AS pos FROM dense),
    t AS (SELECT *, CASE WHEN count(value) OVER w = 25 THEN (sum(value) OVER w - (lag(value, 12) OVER ({W}) + lead(value, 12) OVER ({W})) / 2) / 24 END AS trend
      FROM f WINDOW w AS ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
    b AS (SELECT *, {bare} AS bare, pos % 24 AS ph FROM t),
    s AS (SELECT signal, ph, avg(bare) AS s FROM b GROUP BY ALL), c AS (SELECT signal, avg(s) AS c FROM s GROUP BY signal)
    SELECT signal, ts, trend, {seas} AS seasonal, {resid} AS resid FROM b JOIN s USING (signal, ph) JOIN c USING (signal)"""


for _name, _op in (("additive", "-"), ("multiplicative", "/")):
    @query("W-28", f"rolling_decompose_{_name}", views="grid", r="trend seasonal resid", sql=_decompose_sql(_op))
    def _(v, model=_name):
        d = og.ffill(dense(v), "value", "signal", chunk=None)
        return ro.decompose(d, "value", 24, "signal", model=model).select("signal", "ts", "trend", "seasonal", "resid")


WINDOWS = """e AS (SELECT entity, min(hour) AS a, max(hour) AS b FROM wide GROUP BY entity),
w AS (SELECT entity, unnest(generate_series(0, greatest((epoch(b) - epoch(a) - 86400)::BIGINT // 21600, -1))) AS window_no, a FROM e WHERE epoch(b) - epoch(a) >= 86400),
x AS (SELECT w.entity, window_no, a + window_no * INTERVAL 6 HOUR AS window_start, wide.* EXCLUDE (entity) FROM w JOIN wide ON wide.entity = w.entity
 AND hour >= a + window_no * INTERVAL 6 HOUR AND hour < a + window_no * INTERVAL 6 HOUR + INTERVAL 24 HOUR)"""


@query("W-01", "window_sliding", views="wide", r="click_mean", i="window_no window_rows",
       sql=f"WITH {WINDOWS} SELECT entity, window_no, window_start, count(*) AS window_rows, avg(click) AS click_mean FROM x GROUP BY ALL HAVING count(*) >= 2")
def _(v):
    w = ro.sliding_windows(v.wide, "24h", "6h", "entity")
    return ro.filled_windows(w, "entity", "24h", min_fill=2 / 24, aggs={"click_mean": F.avg("click")})


@query("W-02", "window_rows", views="grid", r="mean", i="window_no window_rows",
       sql=f"""WITH p AS (SELECT signal, value, row_number() OVER ({W}) - 1 AS i FROM grid),
       w AS (SELECT signal, unnest(generate_series(greatest((i - 24) // 12 + 1, 0), i // 12)) AS window_no, value FROM (SELECT signal, value, i FROM p))
       SELECT signal, window_no, count(*) AS window_rows, avg(value) AS mean FROM w GROUP BY ALL HAVING count(*) >= 12""".replace("(i - 24) // 12 + 1", "floor((i - 24) / 12)::BIGINT + 1"))
def _(v):
    d = ro.sliding_rows(v.grid, 24, 12, "signal", chunk=None)
    return d.groupBy("signal", "window_no").agg(F.max("window_rows").alias("window_rows"), F.avg("value").alias("mean"))


def _quality_sql(src, keys, order, sensors):
    part = ", ".join(keys)
    on = f"{part}"
    pos = f"pos AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS i FROM {src})"
    arms = []
    for s in sensors:
        arms.append(f"""SELECT {on}, count(*) AS rows, count({s}) / count(*) AS cov, least(greatest(coalesce(1 - count(*) FILTER (i - l > 1) / nullif(count(*) // 2, 0), 1), 0), 1) AS cont,
        CASE WHEN count({s}) < 3 THEN 0.5 WHEN abs(avg({s})) < 0.001 THEN 1 ELSE exp(-stddev({s}) / abs(avg({s}))) END AS cons FROM (
        SELECT *, CASE WHEN {s} IS NOT NULL THEN last_value(CASE WHEN {s} IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS l FROM pos) GROUP BY {on}""")
    n = len(sensors)
    return f"""{pos}, arms AS ({' UNION ALL '.join(arms)}),
    q AS (SELECT {on}, max(rows) AS rows, coalesce(avg(cov) FILTER (cov > 0.01), 0) AS coverage, coalesce(avg(cont) FILTER (cov > 0.01), 0) AS continuity,
      coalesce(avg(cons) FILTER (cov > 0.01), 0) AS consistency, count(*) FILTER (cov > 0.01) / {n} AS availability FROM arms GROUP BY {on}),
    qs AS (SELECT *, 0.4 * coverage + 0.3 * continuity + 0.2 * consistency + 0.1 * availability AS score FROM q)"""


SENSORS = ["click", "error", "view"]
HOURGRID = """ge AS (SELECT entity, min(hour) AS a, max(hour) AS b FROM wide GROUP BY entity),
gp AS (SELECT entity, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM ge), g AS (SELECT gp.entity, gp.hour, click, error, view FROM gp LEFT JOIN wide USING (entity, hour))"""


def hour_grid(v):
    return og.densify(v.wide.select("entity", "hour", *SENSORS), "1h", "entity", "hour")


@query("V-08", "sparse_quality", views="wide", r="coverage continuity consistency availability score", i="rows",
       sql=f"WITH {HOURGRID}, {_quality_sql('g', ['entity'], 'hour', SENSORS)} SELECT * FROM qs")
def _(v):
    return sp.quality(hour_grid(v), SENSORS, "entity", "hour")


@query("W-03", "window_plan", views="wide", r="overlap quality_threshold", i="window_hours min_sensors",
       sql=f"""WITH {HOURGRID}, {_quality_sql('g', ['entity'], 'hour', SENSORS)} SELECT entity, CASE WHEN coverage > 0.8 THEN 12 WHEN coverage > 0.5 THEN 24 ELSE 48 END AS window_hours,
       CASE WHEN continuity > 0.8 THEN 0.25 WHEN continuity > 0.5 THEN 0.5 ELSE 0.75 END AS overlap, score * 0.8 AS quality_threshold, greatest(ceil(availability * 5), 2) AS min_sensors FROM qs""")
def _(v):
    return sp.window_plan(sp.quality(hour_grid(v), SENSORS, "entity", "hour")).select("entity", "window_hours", "overlap", "quality_threshold", "min_sensors")


@query("W-03", "window_adaptive", views="wide", r="coverage score", i="window_no rows",
       sql=f"""WITH {HOURGRID}, {_quality_sql('g', ['entity'], 'hour', SENSORS)},
       pl AS (SELECT entity, CASE WHEN coverage > 0.8 THEN 12 WHEN coverage > 0.5 THEN 24 ELSE 48 END AS wh, CASE WHEN continuity > 0.8 THEN 0.25 WHEN continuity > 0.5 THEN 0.5 ELSE 0.75 END AS ov, score * 0.8 AS th FROM qs),
       wn AS (SELECT entity, wh, th, greatest(floor(wh * (1 - ov)), 1)::BIGINT AS sl, a, b FROM pl JOIN ge USING (entity)),
       ws AS (SELECT *, unnest(generate_series(0, (epoch(b) - epoch(a) - wh * 3600)::BIGINT // (sl * 3600))) AS window_no FROM wn WHERE epoch(b) - epoch(a) >= wh * 3600),
       src2 AS (SELECT ws.entity, window_no, th, wh, g.hour, click, error, view FROM ws JOIN g ON g.entity = ws.entity AND g.hour >= a + window_no * sl * INTERVAL 1 HOUR AND g.hour < a + (window_no * sl + wh) * INTERVAL 1 HOUR),
       {_quality_sql('src2', ['entity', 'window_no', 'th', 'wh'], 'hour', SENSORS).replace('pos AS', 'pos2 AS').replace('FROM pos)', 'FROM pos2)').replace('arms AS', 'arms2 AS').replace('FROM arms ', 'FROM arms2 ').replace(' q AS', ' q2 AS').replace('qs AS', 'qs2 AS').replace('FROM q)', 'FROM q2)')}
       SELECT entity, window_no, rows, coverage, score FROM qs2 WHERE rows >= wh // 2 AND score >= th""")
def _(v):
    return sp.adaptive_windows(hour_grid(v), SENSORS, "entity").select("entity", "window_no", "rows", "coverage", "score")


@query("W-04", "window_suggest", views="grid", r="adjusted", i="window_size",
       sql=f"""WITH {DENSE}, p AS (SELECT signal, ts, value, row_number() OVER ({W}) - 1 AS i0, count(*) OVER (PARTITION BY signal) AS n FROM dense),
       s AS (SELECT p.*, size, size // 2 AS st FROM p, (VALUES (12), (18), (24)) t(size)),
       w AS (SELECT * EXCLUDE (n, i0), unnest(generate_series(greatest(floor((i0 - size) / st)::BIGINT + 1, 0), least(i0 // st, (n - size) // st))) AS w FROM s WHERE n >= size),
       {_quality_sql('w', ['signal', 'size', 'w'], 'ts', ['value'])},
       b AS (SELECT signal, size, m * (1 - size / 24 * 0.1) AS adjusted FROM (SELECT signal, size, avg(score) AS m FROM qs WHERE score >= 0.1 GROUP BY signal, size))
       SELECT signal, arg_max(size, (adjusted, -size)) AS window_size, max(adjusted) AS adjusted FROM b GROUP BY signal""")
def _(v):
    return sp.suggest_window(dense(v), ["value"], "signal")


@query("V-01", "sparse_coverage_gaps", views="wide", r="coverage longest_gap_hours mean_gap_hours", i="points",
       sql="""SELECT entity, points, coverage, coalesce(longest, 0) AS longest_gap_hours, coalesce(mean, 0) AS mean_gap_hours FROM (SELECT entity, count(click) AS points, count(click) / count(*) AS coverage FROM wide GROUP BY entity)
       LEFT JOIN (SELECT entity, max(h) FILTER (h > 0) AS longest, avg(h) FILTER (h > 0) AS mean FROM (SELECT entity, floor((epoch_us(hour) - epoch_us(lag(hour) OVER (PARTITION BY entity ORDER BY hour))) / 3600e6) AS h FROM wide WHERE click IS NOT NULL) GROUP BY entity) USING (entity)""")
def _(v):
    return sp.coverage_gaps(v.wide, "click", "entity", "hour", chunk=None)


@query("V-02", "sparse_null_runs", views="wide", r="longest_gap_min mean_gap_min", i="gaps",
       sql=f"""WITH {HOURGRID}, s AS (SELECT *, (click IS NULL AND coalesce(lag(click IS NULL) OVER (PARTITION BY entity ORDER BY hour), FALSE) = FALSE)::INT AS st FROM g),
       r AS (SELECT *, sum(st) OVER (PARTITION BY entity ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run FROM s), m AS (SELECT entity, run, count(*) * 60 AS mins FROM r WHERE click IS NULL GROUP BY ALL)
       SELECT entity, count(mins) AS gaps, coalesce(max(mins), 0) AS longest_gap_min, coalesce(avg(mins), 0) AS mean_gap_min FROM ge LEFT JOIN m USING (entity) GROUP BY entity""")
def _(v):
    return sp.null_runs(hour_grid(v), "click", "entity", "hour")


@query("V-03", "sparse_stats", views="readings_n", r="mean std min max range", i="points",
       sql="SELECT entity, count(value) AS points, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range FROM readings_n GROUP BY entity")
def _(v):
    return sp.sparse_stats(v.readings_n, "value", "entity")


@query("V-04", "sparse_changes", views="readings_n", i="changes large_changes mean_crossings sign_changes",
       sql="""WITH p AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY ts) AS p, avg(value) OVER (PARTITION BY entity) AS m, stddev_pop(value) OVER (PARTITION BY entity) AS s FROM readings_n WHERE value IS NOT NULL)
       SELECT entity, count(*) FILTER (value <> p) AS changes, count(*) FILTER (abs(value - p) > 2 * s) AS large_changes, count(*) FILTER ((p - m) * (value - m) < 0) AS mean_crossings,
       count(*) FILTER ((value < 0) <> (p < 0)) AS sign_changes FROM p GROUP BY entity""")
def _(v):
    return sp.change_counts(v.readings_n, "value", "entity", chunk=v.split("entity"))


@query("V-05", "sparse_extremes", views="readings_n", r="extreme_hours", i="extreme_high extreme_low",
       sql="""WITH q AS (SELECT entity, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95, count(value) AS n, count(*) AS slots, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6) AS h FROM readings_n GROUP BY entity),
       c AS (SELECT entity, n, slots, h, count(*) FILTER (value > p95) AS hi, count(*) FILTER (value < p5) AS lo FROM readings_n JOIN q USING (entity) GROUP BY ALL)
       SELECT entity, CASE WHEN n > 10 THEN hi ELSE 0 END AS extreme_high, CASE WHEN n > 10 THEN lo ELSE 0 END AS extreme_low, CASE WHEN n > 10 THEN h * ((hi + lo) / n) * n / slots ELSE 0 END AS extreme_hours FROM c""")
def _(v):
    return sp.extremes(v.readings_n, "value", "entity", chunk=v.split("entity"))


@query("V-06", "sparse_activity", views="readings_n", r="peak_ratio", i="peak_hour active",
       sql="""SELECT entity, count(*) FILTER (r > 0) AS active, arg_max(h, (r, -h)) AS peak_hour, max(r) AS peak_ratio FROM (SELECT entity, hour(ts) AS h, count(value) / count(*) AS r FROM readings_n GROUP BY ALL) GROUP BY entity""")
def _(v):
    return sp.activity(v.readings_n, "value", "entity").select(
        "entity", F.size(F.filter("active_hours", lambda x: x)).alias("active"), "peak_hour", "peak_ratio")


@query("V-07", "sparse_class_coverage", views="wide", r="weekend_vs_weekday night_vs_day",
       sql=f"""WITH {HOURGRID}, c AS (SELECT entity, count(click) FILTER (isodow(hour) >= 6) / nullif(count(*) FILTER (isodow(hour) >= 6), 0) AS we, count(click) FILTER (isodow(hour) < 6) / nullif(count(*) FILTER (isodow(hour) < 6), 0) AS wd,
       count(click) FILTER (hour(hour) NOT BETWEEN 6 AND 17) / nullif(count(*) FILTER (hour(hour) NOT BETWEEN 6 AND 17), 0) AS ni, count(click) FILTER (hour(hour) BETWEEN 6 AND 17) / nullif(count(*) FILTER (hour(hour) BETWEEN 6 AND 17), 0) AS da FROM g GROUP BY entity)
       SELECT entity, coalesce(coalesce(we, 0) / nullif(wd, 0), 0) AS weekend_vs_weekday, coalesce(coalesce(ni, 0) / nullif(da, 0), 0) AS night_vs_day FROM c""")
def _(v):
    return sp.class_coverage(hour_grid(v), "click", "entity", "hour")
