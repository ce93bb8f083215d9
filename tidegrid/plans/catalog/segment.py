"""Islands, label runs, eras."""

from pyspark.sql import functions as F

from ...operators import segment as sg
from ..registry import query

GAP = 43_200_000_000  # 12 h
ISLANDS = f"""isl AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS segment_id FROM (
SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity ORDER BY ts)) > {GAP})::INT, 0) AS new FROM readings))"""


def islands(v):
    return sg.label_islands(v.readings, "12h", "entity", chunk=v.split("entity"))


@query("E-01,E-05", "segment_islands", views="readings", i="segment_id",
       sql=f"WITH {ISLANDS} SELECT event_id, segment_id FROM isl")
def _(v):
    return islands(v).select("event_id", "segment_id")


@query("E-02", "segment_stats", views="readings", r="minutes gap_minutes", i="segment_id rows",
       sql=f"""WITH {ISLANDS} SELECT entity, segment_id, min(ts) AS start_time, max(ts) AS end_time, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 AS minutes,
       count(*) AS rows, FALSE AS has_gaps, 0.0 AS gap_minutes FROM isl GROUP BY ALL HAVING count(*) >= 2""")
def _(v):
    return sg.island_stats(islands(v), "entity", min_rows=2, chunk=v.split("entity"))


@query("E-02,E-04", "segment_merged", views="readings", i="segment_id rows subs", r="gap_minutes",
       sql=f"""WITH {ISLANDS}, m AS (SELECT *, sum(new24) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS merged FROM (
       SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity ORDER BY ts)) AS d, coalesce((d > 86400000000)::INT, 0) AS new24 FROM isl))
       SELECT entity, merged AS segment_id, count(*) AS rows, count(DISTINCT segment_id) AS subs,
       coalesce(sum(d) FILTER (d > {GAP} AND new24 = 0), 0) / 60e6 AS gap_minutes, count(*) FILTER (d > {GAP} AND new24 = 0) > 0 AS has_gaps FROM m GROUP BY ALL""")
def _(v):
    m = sg.merge_small_gaps(islands(v), "24h", "entity", chunk=v.split("entity"))
    stats = sg.island_stats(m, "entity", gap="12h", chunk=v.split("entity")).select("entity", "segment_id", "rows", "gap_minutes", "has_gaps")
    subs = m.groupBy("entity", "segment_id").agg(F.countDistinct("sub_segment_id").alias("subs"))
    return stats.join(subs, ["entity", "segment_id"])


@query("E-03,J-17", "segment_filter", views="readings", i="segment_id",
       sql=f"""WITH {ISLANDS} SELECT event_id, segment_id FROM isl WHERE (entity, segment_id) IN (
       SELECT (entity, segment_id) FROM isl GROUP BY entity, segment_id HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 3600000000 AND count(*) >= 4)""")
def _(v):
    d = islands(v)
    return sg.filter_segments(d, sg.island_stats(d, "entity", chunk=v.split("entity")), "entity", 1.0, 4).select("event_id", "segment_id")


@query("E-08", "segment_quantize", views="readings",
       sql="""SELECT event_id, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE round((value - lo) / (hi - lo) * 7)::INT END AS symbol
       FROM readings JOIN (SELECT signal, min(value) AS lo, max(value) AS hi FROM readings GROUP BY signal) USING (signal)""")
def _(v):
    return sg.quantize(v.readings, "value", 7, "signal").select("event_id", "symbol")


@query("E-10", "segment_apply_breaks", views="readings", i="era_id",
       sql="""SELECT event_id, sum((value > 60)::INT) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS era_id FROM readings""")
def _(v):
    return sg.apply_breaks(v.readings, F.col("value") > 60, "entity", chunk=v.split("entity")).select("event_id", "era_id")


RUNS = """lab AS (SELECT entity, ts, (value > 15)::INT AS label FROM readings),
chg AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS c FROM lab WINDOW w AS (PARTITION BY entity ORDER BY ts)),
num AS (SELECT *, sum(c) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS run FROM chg),
eras AS (SELECT entity, run, label, min(ts) AS start_time, max(ts) AS end_time, count(*) AS rows FROM num GROUP BY ALL)"""


def runs(v):
    return sg.segments_from_labels(v.readings.withColumn("label", (F.col("value") > 15).cast("int")), "label", "entity", chunk=v.split("entity"))


@query("E-11", "segment_runs", views="readings", i="run rows label", sql=f"WITH {RUNS} SELECT * FROM eras")
def _(v):
    return runs(v)


@query("E-12", "segment_break_days", views="readings",
       sql="""SELECT * FROM (SELECT entity, day AS start_day, lead(day) OVER (PARTITION BY entity ORDER BY day) AS end_day FROM (
       SELECT DISTINCT entity, date_trunc('day', ts)::TIMESTAMP AS day FROM readings WHERE value > 40)) WHERE end_day IS NOT NULL""")
def _(v):
    return sg.breaks_to_intervals(v.readings.where("value > 40").select("entity", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")), "entity")


@query("E-13", "segment_daily_counts", views="wide", i="n",
       sql="""WITH d AS (SELECT entity, date_trunc('day', hour)::TIMESTAMP AS day, count(click) + count(error) AS n FROM wide GROUP BY ALL),
       p AS (SELECT entity, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d GROUP BY entity)
       SELECT entity, day, coalesce(n, 0) AS n FROM p LEFT JOIN d USING (entity, day)""")
def _(v):
    return sg.daily_nonnull_counts(v.wide, ["click", "error"], "entity", "hour")


@query("E-14", "segment_config_eras", views="readings",
       sql="""WITH defs AS (SELECT * FROM (VALUES ('Era1', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-10 12:00:00', '5min'),
       ('Era2', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-20 00:00:00', '15min')) t(era, "start", "end", freq))
       SELECT event_id, era, "start", "end", freq FROM (SELECT event_id, defs.*, row_number() OVER (PARTITION BY event_id ORDER BY "start", era) AS r
       FROM readings LEFT JOIN defs ON ts BETWEEN "start" AND "end") WHERE r = 1""")
def _(v):
    defs = v.spark.sql("""SELECT * FROM VALUES ('Era1', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-10 12:00:00', '5min'),
        ('Era2', timestamp_ntz'2024-01-10 00:00:00', timestamp_ntz'2024-01-20 00:00:00', '15min') AS t(era, start, end, freq)""")
    return sg.assign_eras(v.readings.select("event_id", "ts"), defs, "event_id").drop("ts")


@query("E-15", "segment_mean_shift", views="readings", r="score",
       sql="""SELECT event_id, CASE WHEN nl = 5 AND nr = 5 THEN abs(mr - ml) / nullif(sqrt((vl + vr) / 2), 0) END AS score FROM (SELECT event_id,
       count(value) OVER l AS nl, count(value) OVER r AS nr, avg(value) OVER l AS ml, avg(value) OVER r AS mr, var_pop(value) OVER l AS vl, var_pop(value) OVER r AS vr
       FROM readings WINDOW l AS (PARTITION BY signal ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY signal ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))""")
def _(v):
    return sg.mean_shift_score(v.readings, "value", "signal", 5, chunk=v.split("signal")).select("event_id", "score")


@query("E-16", "segment_monthly_eras", views="climate", r="mean_temp", i="windows",
       sql="""WITH w AS (SELECT entity, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, avg(temp) AS temp FROM climate GROUP BY ALL)
       SELECT entity, date_trunc('month', window_start)::TIMESTAMP AS month, min(window_start) AS start_time, max(window_start) + INTERVAL 7 DAY AS end_time,
       count(*) AS windows, avg(temp) AS mean_temp FROM w GROUP BY ALL""")
def _(v):
    from ...frames import bucket

    w = v.climate.groupBy("entity", bucket("ts", "7 days").alias("window_start")).agg(F.avg("temp").alias("temp"))
    return sg.monthly_eras(w, "entity", "7 days", extra={"mean_temp": F.avg("temp")})


@query("E-17", "segment_min_rows", views="readings", i="run rows label", sql=f"WITH {RUNS} SELECT * FROM eras WHERE rows >= 5")
def _(v):
    return sg.min_era_rows(runs(v), 5)


@query("E-18", "segment_month_breaks", views="lines", sql="SELECT entity, date_trunc('month', ts)::TIMESTAMP AS month, min(ts) AS break_time FROM lines GROUP BY ALL")
def _(v):
    return sg.month_breaks(v.lines, "entity")
