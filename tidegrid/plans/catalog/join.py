"""Time joins."""

from pyspark.sql import functions as F

from ...frames import bucket, epoch, from_epoch, split_hot
from ...operators import join as oj
from ..registry import query
from .segment import RUNS, runs


@query("J-01,J-02", "join_external", views="wide price", r="click price",
       sql="SELECT entity, hour, click, price FROM wide LEFT JOIN price USING (hour)")
def _(v):
    return oj.attach_external(v.wide.select("entity", "hour", "click"), v.price, "hour")


@query("J-02", "join_suffix", views="wide", r="click click_site",
       sql="SELECT w.entity, w.hour, w.click, s.click AS click_site FROM wide w LEFT JOIN (SELECT hour, avg(click) AS click FROM wide GROUP BY hour) s USING (hour)")
def _(v):
    site = v.wide.groupBy("hour").agg(F.avg("click").alias("click"))
    return oj.attach_external(v.wide.select("entity", "hour", "click"), site, "hour", suffix="_site")


@query("J-03", "join_daily", views="readings", r="day_mean",
       sql="""SELECT event_id, d.day, day_mean FROM readings r LEFT JOIN (SELECT entity, date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS day_mean FROM readings GROUP BY ALL) d
       ON r.entity = d.entity AND date_trunc('day', r.ts)::TIMESTAMP = d.day""")
def _(v):
    daily = v.readings.groupBy("entity", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.avg("value").alias("day_mean"))
    return oj.join_daily(v.readings, daily, "entity").select("event_id", "day", "day_mean")


@query("J-04", "join_strict", views="wide price", r="click price",
       sql="SELECT entity, hour, click, price FROM wide JOIN price USING (hour)")
def _(v):
    matched = v.wide.join(v.price, "hour", "left_semi").select("entity", "hour", "click")
    return oj.combine_strict(matched, v.price, "hour")


@query("J-04", "join_missing_times", views="wide price", sql="SELECT DISTINCT hour FROM wide WHERE hour NOT IN (SELECT hour FROM price)")
def _(v):
    return oj.missing_times(v.wide, v.price, "hour")


QUOTES = "quotes AS (SELECT entity, ts, value AS quote FROM readings WHERE signal = 'view'), asks AS (SELECT event_id, entity, ts FROM readings WHERE signal <> 'view')"


@query("J-05", "join_asof", views="readings", r="quote",
       sql=f"WITH {QUOTES} SELECT a.event_id, q.quote, q.ts AS quote_ts FROM asks a ASOF LEFT JOIN quotes q ON a.entity = q.entity AND a.ts >= q.ts")
def _(v):
    a = v.readings.where("signal <> 'view'").select("event_id", "entity", "ts")
    q = v.readings.where("signal = 'view'").select("entity", "ts", F.col("value").alias("quote"))
    return oj.asof_join(a, q, "entity", values=["quote"], matched_ts="quote_ts", chunk=v.split("entity")).select("event_id", "quote", "quote_ts")


@query("J-05", "join_asof_ttl", views="readings", r="quote",
       sql=f"""WITH {QUOTES} SELECT a.event_id, CASE WHEN epoch_us(a.ts) - epoch_us(q.ts) <= 43200000000 THEN q.quote END AS quote
       FROM asks a ASOF LEFT JOIN quotes q ON a.entity = q.entity AND a.ts >= q.ts""")
def _(v):
    a = v.readings.where("signal <> 'view'").select("event_id", "entity", "ts")
    q = v.readings.where("signal = 'view'").select("entity", "ts", F.col("value").alias("quote"))
    return oj.asof_join(a, q, "entity", values=["quote"], tolerance="12h", chunk=v.split("entity")).select("event_id", "quote")


@query("J-05", "join_asof_forward", views="readings", r="quote",
       sql=f"WITH {QUOTES} SELECT a.event_id, q.quote FROM asks a ASOF LEFT JOIN quotes q ON a.entity = q.entity AND a.ts <= q.ts")
def _(v):
    a = v.readings.where("signal <> 'view'").select("event_id", "entity", "ts")
    q = v.readings.where("signal = 'view'").select("entity", "ts", F.col("value").alias("quote"))
    return oj.asof_join(a, q, "entity", values=["quote"], direction="forward", chunk=v.split("entity")).select("event_id", "quote")


@query("J-06,J-08", "join_era_progress", views="readings", r="progress", i="run",
       sql=f"""WITH {RUNS}, m AS (SELECT r.event_id, r.ts, e.run, e.start_time, e.end_time, row_number() OVER (PARTITION BY event_id ORDER BY start_time, run) AS k
       FROM readings r LEFT JOIN (SELECT * FROM eras WHERE label = 1) e ON r.entity = e.entity AND r.ts BETWEEN e.start_time AND e.end_time)
       SELECT event_id, run, CASE WHEN start_time = end_time THEN 0.5 ELSE least(greatest((epoch_us(ts) - epoch_us(start_time)) / nullif(epoch_us(end_time) - epoch_us(start_time), 0), 0), 1) END AS progress
       FROM m WHERE k = 1""")
def _(v):
    eras = runs(v).where("label = 1").select("entity", "run", "start_time", "end_time")
    d = oj.interval_join(v.readings.select("event_id", "entity", "ts"), eras, "ts", "start_time", "end_time", keys="entity",
                         row_id="event_id", first_by=["start_time", "run"], disjoint=True, chunk=v.split("entity"))
    return d.select("event_id", "run", oj.era_progress("ts", "start_time", "end_time").alias("progress"))


ISL = """isl AS (SELECT entity, sum(new) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS segment_id, ts FROM (
SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity ORDER BY ts)) > 43200000000)::INT, 0) AS new FROM readings)),
par AS (SELECT entity, segment_id AS era_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS rows FROM isl GROUP BY ALL)"""


@query("J-07,M-06,M-07", "join_parent_era", views="readings", r="rows_ratio rows_diff duration_ratio", i="run parent_era_id parent_rows",
       sql=f"""WITH {RUNS}, {ISL}, p AS (SELECT e.*, par.era_id AS parent_era_id, par.rows AS parent_rows, par.start_time AS ps, par.end_time AS pe,
       row_number() OVER (PARTITION BY e.entity, e.run ORDER BY par.start_time, par.end_time) AS k
       FROM eras e LEFT JOIN par ON e.entity = par.entity AND par.start_time <= e.start_time AND par.end_time >= e.end_time)
       SELECT entity, run, parent_era_id, parent_rows, rows / (parent_rows + 1e-8) AS rows_ratio, rows - parent_rows AS rows_diff,
       ((epoch_us(end_time) - epoch_us(start_time)) / 3600e6) / ((epoch_us(pe) - epoch_us(ps)) / 3600e6 + 1e-8) AS duration_ratio FROM p WHERE k = 1""")
def _(v):
    from ...operators import model as om
    from ...operators import segment as sg

    parent = sg.island_stats(sg.label_islands(v.readings, "12h", "entity", chunk=v.split("entity")), "entity", chunk=v.split("entity")).withColumnRenamed("segment_id", "era_id")
    hours = lambda d: d.withColumn("hours", (epoch("end_time") - epoch("start_time")) / 3600e6)
    d = oj.parent_era(hours(runs(v)), hours(parent), "entity", child_id=["entity", "run"], parent_cols=["era_id", "rows", "hours"])
    d = om.cross_level(d, {"rows": "parent_rows"}, durations=("hours", "parent_hours"))
    return d.select("entity", "run", "parent_era_id", "parent_rows", "rows_ratio", "rows_diff", "duration_ratio")


@query("J-08,F-37", "join_era_context", views="readings", r="time_scale_ratio temperature_setpoint_low temperature_setpoint_high light_intensity_low energy_consumption plant_growth",
       sql="""SELECT event_id, CASE WHEN signal = 'click' THEN 'high' ELSE 'mixed' END AS stability, value / (entity + 1 + 1e-6) AS time_scale_ratio,
       CASE WHEN value > 20 THEN 18 ELSE 17 END AS temperature_setpoint_low, CASE WHEN value > 20 THEN 26 ELSE 27 END AS temperature_setpoint_high,
       CASE WHEN signal = 'view' THEN 120 ELSE 100 END AS light_intensity_low,
       CASE WHEN signal = 'click' THEN 1.2 / 4.3 ELSE 1.0 / 4.5 END AS energy_consumption, CASE WHEN signal = 'click' THEN 1.0 / 4.3 ELSE 1.3 / 4.5 END AS plant_growth FROM readings""")
def _(v):
    d = v.readings.withColumns({"b": F.lit("click"), "c": F.lit("click"), "hc": F.col("entity") + 1.0})
    d = d.withColumns(oj.era_hierarchy(["signal", "b", "c"], "value", "hc"))
    d = d.withColumns({"fine": F.col("value") > 20, "critical": F.col("signal") == "view"})
    b = oj.era_bounds({"temperature_setpoint": (17.0, 27.0), "light_intensity": (100.0, 800.0)}, "fine", "critical")
    b.pop("light_intensity_high")
    w = oj.era_weights("stability")
    return d.select("event_id", "stability", "time_scale_ratio", *[x.alias(n) for n, x in b.items()],
                    w["energy_consumption"].alias("energy_consumption"), w["plant_growth"].alias("plant_growth"))


@query("J-09", "join_window_external", views="readings price", r="price_mean", i="price_n",
       sql="""WITH w AS (SELECT entity, time_bucket(INTERVAL 12 HOUR, ts) AS window_start, time_bucket(INTERVAL 12 HOUR, ts) + INTERVAL 24 HOUR AS window_end FROM readings GROUP BY ALL)
       SELECT w.entity, window_start, window_end, avg(price) AS price_mean, nullif(count(price), 0) AS price_n FROM w LEFT JOIN price ON hour BETWEEN window_start AND window_end GROUP BY ALL""")
def _(v):
    w = v.readings.select("entity", bucket("ts", "12h").alias("window_start")).distinct()
    w = w.withColumn("window_end", from_epoch(epoch("window_start") + 86_400_000_000))
    return oj.window_external(w, v.price, "hour", {"price_mean": F.avg("price"), "price_n": F.count("price")})


@query("J-10", "join_overlap", views="wide", r="ratio", i="overlap",
       sql="""SELECT entity, a, b, overlap, overlap / nullif(either, 0) AS ratio FROM (
       SELECT entity, 'click' AS a, 'view' AS b, count(*) FILTER (click IS NOT NULL AND view IS NOT NULL) AS overlap, count(*) FILTER (click IS NOT NULL OR view IS NOT NULL) AS either FROM wide GROUP BY entity
       UNION ALL SELECT entity, 'click', 'error', count(*) FILTER (click IS NOT NULL AND error IS NOT NULL), count(*) FILTER (click IS NOT NULL OR error IS NOT NULL) FROM wide GROUP BY entity)""")
def _(v):
    return oj.pairwise_overlap(v.wide, [("click", "view"), ("click", "error")], "entity")


@query("J-11,U-06", "join_intersect_time", views="grid",
       sql="SELECT ts FROM grid WHERE signal = 'click' INTERSECT SELECT ts FROM grid WHERE signal = 'error'")
def _(v):
    return oj.intersect_time(v.grid.where("signal = 'click'"), v.grid.where("signal = 'error'"), "ts")


@query("J-12", "join_correlate", views="climate price_daily", r="corr", i="n", digits=5,
       sql="""WITH j AS (SELECT c.*, p.price AS spot FROM climate c JOIN price_daily p ON c.ts = p.day)
       SELECT 'temp' AS factor, corr(spot, temp) AS corr, count(*) AS n FROM j UNION ALL SELECT 'power', corr(spot, power), count(*) FROM j""")
def _(v):
    ext = v.price_daily.select(F.col("day").alias("ts"), F.col("price").alias("spot"))
    return oj.correlate_with(v.climate, ext, "ts", "spot", ["temp", "power"])


@query("J-13", "join_stream_map",
       sql="""SELECT user_id AS entity, ts, value, m.target FROM events JOIN (VALUES ('click', 'temp'), ('view', 'light')) m(uuid, target) ON event_type = m.uuid""")
def _(v):
    from ...sources.files import map_streams

    e = v.table("events").select(F.col("user_id").alias("entity"), "ts", "value", F.col("event_type").alias("uuid"))
    return map_streams(e, {"click": "temp", "view": "light"}).drop("uuid")


@query("J-15,W-19", "join_lagged", views="readings", r="value_lag_1 value_lag_4",
       sql="""SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 4) OVER w AS value_lag_4 FROM readings WINDOW w AS (PARTITION BY signal ORDER BY ts)""")
def _(v):
    return oj.lagged(v.readings, "value", [1, 4], "signal", chunk=v.split("signal")).select("event_id", "value_lag_1", "value_lag_4")


@query("J-14", "join_knn", r="c_acctbal",
       sql="""WITH d AS (SELECT s_suppkey, s_acctbal, s_nationkey AS n2, s_suppkey % 7 + s_acctbal / 100 AS y FROM supplier),
       p AS (SELECT c_custkey, y, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt(pow(c_acctbal - s_acctbal, 2) + pow(c_nationkey - n2, 2)), s_suppkey) AS k
       FROM customer, d) SELECT c_custkey, avg(y) AS c_acctbal FROM p WHERE k <= 3 GROUP BY c_custkey""")
def _(v):
    lit = v.table("supplier").withColumn("c_acctbal_y", F.col("s_suppkey") % 7 + F.col("s_acctbal") / 100)
    out = oj.knn_lookup(v.table("customer"), lit, {"c_acctbal": "s_acctbal", "c_nationkey": "s_nationkey"},
                        row_id="c_custkey", donor_id="s_suppkey", target="c_acctbal_y", chunk=split_hot(v.table("customer"), (), v.limit))
    return out.withColumnRenamed("c_acctbal_y", "c_acctbal")


@query("J-14", "join_literature", views="climate", r="size",
       sql="""WITH d AS (SELECT p_partkey, p_size, p_retailprice / 40 AS light, p_size + 20 AS temp FROM part
         WHERE contains(lower(p_name), 'blue') AND p_type = 'MEDIUM' AND p_size % 2 = 0),
       e AS (SELECT entity, avg(light) AS light, avg(temp) AS temp FROM climate GROUP BY entity),
       p AS (SELECT entity, p_size, row_number() OVER (PARTITION BY entity ORDER BY sqrt(pow(e.light - d.light, 2) + pow(e.temp - d.temp, 2)), p_partkey) AS k FROM e, d)
       SELECT entity, avg(p_size) AS size FROM p WHERE k <= 3 GROUP BY entity""")
def _(v):
    table = v.table("part").withColumns({"light": F.col("p_retailprice") / 40, "temp": F.col("p_size") + 20,
                                          "unit": F.when(F.col("p_size") % 2 == 0, "cm").otherwise("mm")})
    lit = oj.literature_of(table, "BLUE", "MEDIUM", "cm", columns=("p_name", "p_type", "unit"))
    eras = v.climate.groupBy("entity").agg(F.avg("light").alias("light"), F.avg("temp").alias("temp"))
    out = oj.knn_lookup(eras, lit, {"light": "light", "temp": "temp"}, row_id="entity", donor_id="p_partkey", target="p_size", chunk=v.split(of="climate"))
    return out.withColumnRenamed("p_size", "size")
