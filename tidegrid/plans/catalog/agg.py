"""Aggregates and profiles."""

from pyspark.sql import functions as F

from ...operators import agg as oa
from ..registry import query
from ..views import SIGNALS
from .segment import RUNS, runs

HOURLY = ", ".join(f"avg(\"{c}\") AS {c}_mean, count(\"{c}\") AS {c}_count, stddev(\"{c}\") AS {c}_std, min(\"{c}\") AS {c}_min, max(\"{c}\") AS {c}_max"
                   for c in ("click", "view"))
FLAT = ("flat AS (SELECT entity, ts, CASE WHEN signal = 'click' THEN value END AS click, CASE WHEN signal = 'view' THEN value END AS \"view\", "
        "CASE WHEN signal = 'error' THEN value > 20 END AS lamp FROM readings)")


def flat(v):
    """One row per reading with the value in its signal's column, as in a wide sensor table."""
    s = F.col("signal")
    return v.readings.select("entity", "ts", F.when(s == "click", F.col("value")).alias("click"),
                             F.when(s == "view", F.col("value")).alias("view"),
                             F.when(s == "error", F.col("value") > 20).alias("lamp"))


@query("G-01,G-02", "agg_hourly", views="readings",
       r=" ".join(f"{c}_{s}" for c in ("click", "view") for s in ("mean", "std", "min", "max")) + " lamp_ratio",
       i="click_count view_count total_records",
       sql=f"""WITH {FLAT} SELECT entity, date_trunc('hour', ts)::TIMESTAMP AS hour, {HOURLY}, bool_or(coalesce(lamp, FALSE)) AS lamp_on,
       avg(coalesce(lamp, FALSE)::INT) AS lamp_ratio, count(*) AS total_records FROM flat GROUP BY ALL""")
def _(v):
    return oa.hourly(flat(v), ["click", "view"], "entity", lamps=["lamp"])


@query("G-03", "agg_coverage", views="readings", r="click_coverage view_coverage overall_coverage", i="click_count view_count",
       sql=f"""WITH {FLAT} SELECT *, click_count / 24 AS click_coverage, view_count / 24 AS view_coverage, (click_count + view_count) / 48 AS overall_coverage
       FROM (SELECT entity, date_trunc('day', ts)::TIMESTAMP AS day, count(click) AS click_count, count("view") AS view_count FROM flat GROUP BY ALL)""")
def _(v):
    d = flat(v).groupBy("entity", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count("click").alias("click_count"), F.count("view").alias("view_count"))
    return oa.coverage(d, ["click_count", "view_count"], 24)


@query("G-04", "agg_daily", views="lines", r="temp_daily_mean temp_daily_min temp_daily_max temp_daily_std light_daily_mean light_daily_min light_daily_max light_daily_std light_daily_sum",
       sql="""SELECT entity, ts AS day, avg(temp) AS temp_daily_mean, min(temp) AS temp_daily_min, max(temp) AS temp_daily_max, stddev(temp) AS temp_daily_std,
       avg(light) AS light_daily_mean, min(light) AS light_daily_min, max(light) AS light_daily_max, stddev(light) AS light_daily_std, sum(light) AS light_daily_sum
       FROM lines GROUP BY ALL""")
def _(v):
    return oa.daily(v.lines, ["temp", "light"], "entity")


@query("G-05", "agg_weekly", views="lines", r="temp_weekly_mean temp_weekly_min temp_weekly_max temp_weekly_std",
       sql="""SELECT entity, (date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 7 DAY)::TIMESTAMP AS week, avg(temp) AS temp_weekly_mean,
       min(temp) AS temp_weekly_min, max(temp) AS temp_weekly_max, stddev(temp) AS temp_weekly_std FROM lines GROUP BY ALL""")
def _(v):
    return oa.weekly(v.lines, ["temp"], "entity")


for _grain in ("hour", "day", "week", "month"):
    @query("G-06", f"agg_price_{_grain}", views="readings", r="price",
           sql=f"SELECT date_trunc('{_grain}', ts)::TIMESTAMP AS {_grain}, avg(value) AS price FROM readings GROUP BY ALL")
    def _(v, grain=_grain):
        return oa.price_series(v.readings, "value", "ts", grain)


STATS = "mean std min max skewness kurtosis p5 p25 p50 p75 p95 mad iqr entropy"


@query("G-07,X-05", "agg_ext_stats", views="readings_n", r=STATS, i="count", digits=5,
       sql="""WITH x AS (SELECT signal, value FROM readings_n WHERE value IS NOT NULL),
       s AS (SELECT signal, avg(value) AS mean, stddev(value) AS std, min(value) AS min, max(value) AS max,
         (avg(pow(value, 3)) - 3 * avg(value) * avg(pow(value, 2)) + 2 * pow(avg(value), 3)) / pow(var_pop(value), 1.5) AS skewness,
         kurtosis_pop(value) AS kurtosis, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
         quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, count(*) AS count FROM x GROUP BY signal),
       m AS (SELECT signal, median(abs(value - p50)) AS mad FROM x JOIN s USING (signal) GROUP BY signal),
       b AS (SELECT signal, least(floor((value - min) / (max - min) * 50), 49) AS bin, count(*) AS c, any_value(count) AS n FROM x JOIN s USING (signal) GROUP BY ALL),
       e AS (SELECT signal, -sum(c / n * ln(c / n)) AS entropy FROM b GROUP BY signal)
       SELECT s.*, mad, p75 - p25 AS iqr, entropy FROM s JOIN m USING (signal) JOIN e USING (signal)""")
def _(v):
    return oa.ext_stats(v.readings_n, "value", "signal", chunk=v.split("signal"))


@query("G-08", "agg_block_stats", views="readings", r="mean std range cv energy",
       sql="""SELECT entity, avg(value) AS mean, stddev_pop(value) AS std, max(value) - min(value) AS range, stddev_pop(value) / nullif(abs(avg(value)), 0) AS cv,
       sum(value * value) AS energy, arg_min(ts, (value, ts)) AS argmin, arg_min(ts, (-value, ts)) AS argmax FROM readings GROUP BY entity""")
def _(v):
    return oa.block_stats(v.readings, "value", "entity")


@query("G-09", "agg_basic_stats", views="readings_n", r="mean std min max", i="count",
       sql="""SELECT entity, signal, avg(value) AS mean, stddev(value) AS std, min(value) AS min, max(value) AS max, count(value) AS count FROM readings_n GROUP BY ALL""")
def _(v):
    return oa.basic_stats(v.readings_n, "value", ["entity", "signal"])


@query("G-10", "agg_column_profile", views="readings_n", r="missing_pct mean std", i="missing uniques",
       sql="""SELECT 'value' AS "column", 'double' AS dtype, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value IS NULL) / count(*) * 100 AS missing_pct,
       count(DISTINCT value) AS uniques, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev(value) AS std FROM readings_n
       UNION ALL SELECT 'signal', 'string', count(*) FILTER (signal IS NULL), 0, count(DISTINCT signal), NULL, NULL, NULL, NULL FROM readings_n""")
def _(v):
    return oa.column_profile(v.readings_n, ["value", "signal"])


@query("G-11,L-03", "agg_completeness", views="wide", r="completeness",
       sql=" UNION ALL ".join(f"SELECT '{s}' AS \"column\", count(\"{s}\") / count(*) AS completeness FROM wide" for s in SIGNALS).join(("SELECT * FROM (", ") ORDER BY completeness DESC, \"column\" LIMIT 3")))
def _(v):
    return oa.completeness(v.wide, SIGNALS, 3)


@query("G-12", "agg_status_ratio", views="readings", r="ratio",
       sql="""SELECT 'hot' AS "column", avg(r) AS ratio FROM (SELECT avg((value > 15)::INT) AS r FROM readings GROUP BY entity)
       UNION ALL SELECT 'cold', avg(r) FROM (SELECT avg((value < 5)::INT) AS r FROM readings GROUP BY entity)""")
def _(v):
    d = v.readings.withColumns({"hot": F.col("value") > 15, "cold": F.col("value") < 5})
    return oa.status_ratio(d, ["hot", "cold"], "entity")


@query("G-13,L-04", "agg_value_counts", views="readings_n", i="n",
       sql="SELECT value, count(*) AS n FROM readings_n GROUP BY value ORDER BY n DESC, value NULLS FIRST LIMIT 20")
def _(v):
    return oa.value_counts(v.readings_n, "value", 20)


@query("G-14", "agg_missing_matrix", views="wide",
       sql="""SELECT entity, bucket, unnest(['click', 'error']) AS "column", unnest([a, b]) AS missing FROM (
       SELECT entity, date_trunc('day', hour)::TIMESTAMP AS bucket, count(click) = 0 AS a, count(error) = 0 AS b FROM wide GROUP BY ALL)""")
def _(v):
    return oa.missing_matrix(v.wide, ["click", "error"], "1 day", "entity", "hour")


@query("G-15", "agg_availability", views="wide",
       sql="""SELECT *, click_present::INT + error_present::INT AS n_present, click_present AND error_present AS all_present FROM (
       SELECT entity, time_bucket(INTERVAL 6 HOUR, hour) AS bucket, bool_or(click IS NOT NULL) AS click_present, bool_or(error IS NOT NULL) AS error_present FROM wide GROUP BY ALL)""")
def _(v):
    return oa.availability(v.wide, ["click", "error"], "6h", "entity", "hour")


@query("G-16", "agg_map_profile", views="readings", r="suitability", i="sensors readings rows",
       sql="SELECT entity, 1 AS sensors, count(*) AS readings, count(*) AS rows, 1.0 AS suitability FROM readings GROUP BY entity")
def _(v):
    return oa.map_profile(v.readings, "props", "entity")


@query("G-17", "agg_era_stats", views="readings", r="avg_rows", i="eras min_rows max_rows",
       sql=f"WITH {RUNS} SELECT entity, count(*) AS eras, avg(rows) AS avg_rows, min(rows) AS min_rows, max(rows) AS max_rows FROM eras GROUP BY entity")
def _(v):
    return oa.era_stats(runs(v), "entity")


@query("G-18", "agg_on_hours", views="readings", r="on_hours",
       sql="""SELECT entity, date_trunc('day', ts)::TIMESTAMP AS day, sum(CASE WHEN value > 15 THEN least(coalesce(nx - epoch_us(ts), 0), 86400000000) / 3600e6 ELSE 0 END) AS on_hours FROM (
       SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY entity ORDER BY ts) AS nx FROM readings) GROUP BY ALL""")
def _(v):
    return oa.on_hours(v.readings.withColumn("on", F.col("value") > 15), "on", "entity", chunk=v.split("entity"))


@query("G-19", "agg_hour_profile", views="readings", r="mean", i="hour n",
       sql="SELECT signal, hour(ts) AS hour, avg(value) AS mean, count(value) AS n FROM readings GROUP BY ALL")
def _(v):
    return oa.hour_profile(v.readings, "value", "signal")


@query("G-20", "agg_by_state", views="lines", r="q25 q50 q75 mean", i="n",
       sql="""SELECT status, line, quantile_cont(light, 0.25) AS q25, quantile_cont(light, 0.5) AS q50, quantile_cont(light, 0.75) AS q75, avg(light) AS mean, count(*) AS n FROM lines GROUP BY ALL""")
def _(v):
    return oa.by_state(v.lines, "light", ["status", "line"], chunk=v.split("status", "line", of="lines"))


@query("G-21", "agg_corr_matrix", views="climate", r="corr", digits=5,
       sql=" UNION ALL ".join(f"SELECT entity, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM climate GROUP BY entity"
                              for a, b in (("temp", "rh"), ("temp", "light"), ("rh", "light"))))
def _(v):
    return oa.corr_matrix(v.climate, ["temp", "rh", "light"], "entity")


@query("G-22", "agg_pair_corr", views="wide", r="corr", i="n", digits=5,
       sql="""SELECT 'click' AS a, 'view' AS b, count(*) FILTER (click IS NOT NULL AND view IS NOT NULL) AS n, CASE WHEN count(*) FILTER (click IS NOT NULL AND view IS NOT NULL) > 10 THEN corr(click, view) ELSE 0 END AS corr FROM wide
       UNION ALL SELECT 'error', 'signup', count(*) FILTER (error IS NOT NULL AND signup IS NOT NULL), CASE WHEN count(*) FILTER (error IS NOT NULL AND signup IS NOT NULL) > 10 THEN corr(error, signup) ELSE 0 END FROM wide""")
def _(v):
    return oa.pair_corr(v.wide, [("click", "view"), ("error", "signup")])


@query("G-23", "agg_dim_stats", views="climate", r="temp dim_s_acctbal_mean dim_s_acctbal_std",
       sql="SELECT entity, ts, temp, (SELECT avg(s_acctbal) FROM supplier) AS dim_s_acctbal_mean, (SELECT stddev(s_acctbal) FROM supplier) AS dim_s_acctbal_std FROM climate")
def _(v):
    return oa.attach_dim_stats(v.climate.select("entity", "ts", "temp"), v.table("supplier"), ["s_acctbal"])


@query("G-24,Q-04,Q-05", "agg_stage_counts", views="readings", i="rows days entities signals",
       sql="SELECT count(*) AS rows, count(DISTINCT date_trunc('day', ts)) AS days, count(DISTINCT entity) AS entities, count(DISTINCT signal) AS signals, min(ts) AS first_ts, max(ts) AS last_ts FROM readings")
def _(v):
    from ...operators.quality import stage_counts

    return stage_counts(v.readings, days="ts", distinct={"entities": "entity", "signals": "signal"})


@query("G-25", "agg_summarize_runs", views="solutions", r="mean std median iqr min max", i="n",
       sql="""SELECT algorithm, avg(f1) AS mean, stddev_pop(f1) AS std, median(f1) AS median, quantile_cont(f1, 0.75) - quantile_cont(f1, 0.25) AS iqr, min(f1) AS min, max(f1) AS max, count(f1) AS n
       FROM solutions GROUP BY algorithm""")
def _(v):
    return oa.summarize_runs(v.solutions, "f1", "algorithm", chunk=v.split("algorithm", of="solutions"))


@query("G-26", "agg_runs", views="solutions", r="f1_mean f1_std f2_mean f2_std", i="runs",
       sql="SELECT run, algorithm, avg(f1) AS f1_mean, stddev_pop(f1) AS f1_std, avg(f2) AS f2_mean, stddev_pop(f2) AS f2_std, count(*) AS runs FROM solutions GROUP BY ALL")
def _(v):
    return oa.aggregate_runs(v.solutions, ["f1", "f2"], ["run", "algorithm"])


@query("G-27", "agg_mean_on_hours", views="readings", r="on_hours",
       sql="SELECT entity, date_trunc('month', ts)::TIMESTAMP AS month, avg((value > 15)::INT) * 24 AS on_hours FROM readings GROUP BY ALL")
def _(v):
    return oa.mean_on_hours(v.readings.withColumn("on", F.col("value") > 15), "on", "entity", "month")


@query("G-28", "agg_describe", views="climate", r="missing_pct mean std min max", i="missing uniques", digits=5,
       sql=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'double' AS dtype, count(*) FILTER ({c} IS NULL) AS missing, 100 * count(*) FILTER ({c} IS NULL) / count(*) AS missing_pct, "
                              f"count(DISTINCT {c}) AS uniques, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev({c}) AS std FROM climate" for c in ("temp", "power")))
def _(v):
    return oa.column_profile(v.climate, ["temp", "power"])


@query("G-29", "agg_heat_table", views="readings", r="mean", i="k1 k2 n",
       sql="SELECT isodow(ts) AS k1, hour(ts) AS k2, avg(value) AS mean, count(value) AS n FROM readings GROUP BY ALL")
def _(v):
    return oa.heat_table(v.readings, "value", F.weekday("ts") + 1, F.hour("ts"))


@query("W-29", "agg_partition_count", views="readings", i="partition_rows",
       sql="SELECT event_id, count(*) OVER (PARTITION BY signal, entity) AS partition_rows FROM readings")
def _(v):
    return oa.partition_count(v.readings, ["signal", "entity"]).select("event_id", "partition_rows")


@query("W-22", "agg_change_stats", views="readings", r="mean_change std_change",
       sql="""SELECT entity, signal, avg(d) AS mean_change, stddev(d) AS std_change FROM (SELECT entity, signal, value - lag(value) OVER (PARTITION BY entity, signal ORDER BY ts) AS d FROM readings) GROUP BY ALL""")
def _(v):
    return oa.change_stats(v.readings, "value", ["entity", "signal"], chunk=v.split("entity", "signal"))


@query("W-27", "agg_day_total", views="lines", r="day_total",
       sql="SELECT orderkey, line, entity, ts, light, sum(light) OVER (PARTITION BY entity, ts) AS day_total FROM lines")
def _(v):
    return oa.daily_total(v.lines, "light", "entity").select("orderkey", "line", "entity", "ts", "light", "day_total")


@query("L-01,L-02,L-03", "agg_top_k", views="readings", r="value",
       sql="SELECT event_id, value FROM readings ORDER BY value DESC, event_id LIMIT 50")
def _(v):
    return oa.top_k(v.readings.select("event_id", "value"), "value", 50, "event_id")


@query("L-05", "agg_cheapest_quartile", views="price", r="price",
       sql="SELECT hour, price FROM price WHERE price <= (SELECT quantile_cont(price, 0.25) FROM price)")
def _(v):
    return oa.cheapest_quartile(v.price, "price", chunk=None)


@query("U-01,U-02,U-05", "agg_union_levels", views="readings", r="value", i="entity n",
       sql="""SELECT 'A' AS level, entity, avg(value) AS value, NULL::BIGINT AS n FROM readings GROUP BY entity UNION ALL SELECT 'B', entity, NULL, count(*) FROM readings GROUP BY entity""")
def _(v):
    from ...operators.model import concat_levels

    a = v.readings.groupBy("entity").agg(F.avg("value").alias("value"))
    b = v.readings.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return concat_levels({"A": a, "B": b})


