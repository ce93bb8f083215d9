"""Files, tables and streams: data written by Spark from the driver tables and read back."""

from pyspark.sql import functions as F

from ...frames import bucket
from ...operators.clean import latest_by
from ...sources import files as sf
from ...sources import tables as st
from ...streaming import live
from ..registry import query


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("A-01,A-02,A-07,A-09", "source_csv", views="readings_n", r="value", i="entity",
       sql="SELECT event_id, entity, date_trunc('second', ts)::TIMESTAMP AS ts, value, signal, 'aux' AS source_system, value > 20 AND value IS NOT NULL AS hot FROM readings_n")
def _(v):
    path = st.scratch(v.spark) + "/csv"
    d = v.readings_n.select(
        F.date_format("ts", "dd-MM-yyyy").alias("Day"), F.date_format("ts", "HH:mm:ss").alias("Clock"), "event_id", F.col("entity").alias("who"),
        F.translate(F.col("value").cast("string"), ".", ",").alias("Value"), "signal",
        F.when(F.col("value") > 20, "ON").otherwise("").alias("hot"))
    st.save_csv(d, path, sep=";")
    C = sf.ColumnSpec
    spec = sf.FileSpec(path, delimiter=";", date="Day", time="Clock", fmt="%d-%m-%Y %H:%M:%S", source_system="aux", null_markers=("", "NaN"),
                       columns=(C("event_id", "event_id", "int"), C(3, "entity", "int"), C("Value", "value"), C("signal", "signal", "string"), C("hot", "hot", "bool")))
    return sf.read_csv(v.spark, spec).rows.select("event_id", "entity", "ts", "value", "signal", "source_system", "hot")


@query("A-03,A-06", "source_interval_csv", views="readings", r="value", i="entity",
       sql="SELECT entity, date_trunc('hour', ts)::TIMESTAMP AS ts, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 59 MINUTE AS ts_end, avg(value) AS value FROM readings GROUP BY ALL")
def _(v):
    path = st.scratch(v.spark) + "/interval"
    d = v.readings.groupBy("entity", bucket("ts", "1h").alias("h")).agg(F.avg("value").alias("value"))
    d = d.select(F.date_format("h", "yyyy-MM-dd HH:mm").alias("Start"), F.date_format(F.col("h") + F.expr("INTERVAL 59 MINUTES"), "yyyy-MM-dd HH:mm").alias("End"),
                 F.col("entity").cast("string").alias("entity"), F.col("value").cast("string").alias("value [x]"))
    st.save_csv(d, path)
    C = sf.ColumnSpec
    spec = sf.FileSpec(path, format="interval_csv", fmt="%Y-%m-%d %H:%M", columns=(C("entity", "entity", "int"), C("value [x]", "value")))
    return sf.read_interval_csv(v.spark, spec).rows.select("entity", "ts", "ts_end", "value")


@query("A-06", "source_rejects", views="readings",
       sql="SELECT CAST(event_id AS VARCHAR) || ';not a time' AS raw, 'invalid timestamp' AS reason FROM readings WHERE value > 40")
def _(v):
    path = st.scratch(v.spark) + "/rejects"
    d = v.readings.select("event_id", F.when(F.col("value") > 40, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("when"))
    st.save_csv(d, path, sep=";")
    spec = sf.FileSpec(path, delimiter=";", datetime="when", columns=(sf.ColumnSpec("event_id", "event_id", "int"),))
    return sf.read_csv(v.spark, spec).rejects.select("raw", "reason")


@query("A-04,A-05,J-13", "source_ingest", views="readings", r="light temp",
       sql="""SELECT make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts, format_type, light, temp FROM (
       SELECT ts, 'stream_json' AS format_type, CASE WHEN signal = 'view' THEN value END AS light, CASE WHEN signal = 'click' THEN value END AS temp FROM readings WHERE signal IN ('view', 'click')
       UNION ALL SELECT ts, 'csv', NULL, value FROM readings WHERE signal = 'error')""")
def _(v):
    root = st.scratch(v.spark)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    one = F.struct(F.col("signal").alias("uuid"), F.collect_list(F.array(ms.cast("double"), F.col("value"))).alias("Readings"))
    day = v.readings.where("signal <> 'error'").groupBy("signal", "entity", F.to_date("ts")).agg(F.to_json(F.array(one)).alias("value"))
    day.select("value").write.mode("overwrite").text(root + "/json")
    st.save_csv(v.readings.where("signal = 'error'").select(ms.alias("timestamp"), F.col("value").cast("string").alias("t")), root + "/csv", sep=";")
    specs = [sf.FileSpec(root + "/json", format="stream_json", streams={"view": "light", "click": "temp"}, multi_line=False),
             sf.FileSpec(root + "/csv", delimiter=";", unix_ms="timestamp", columns=(sf.ColumnSpec("t", "temp"),)),
             sf.FileSpec(root + "/absent", delimiter=";", header_rows=0, unix_ms=0)]
    got = sf.ingest(v.spark, specs)
    if len(got.failed) != 1:
        raise AssertionError("the missing source must be reported")
    return got.rows.select("ts", "format_type", "light", "temp")


@query("A-05,A-01", "source_corrupt", views="readings", r="value", i="broken",
       sql="SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts, value, 2 AS broken FROM readings")
def _(v):
    """Compressed files with two headers, one of them cut short a second time, and a file that is no archive: the rest is read whole."""
    root = st.scratch(v.spark) + "/csv"
    d = v.readings.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), F.col("value").cast("string").alias("v"), "event_id")
    odd = F.col("event_id") % 2 == 1
    for part in (d.where(odd), d.where(~odd).select("event_id", "v", "when")):
        part.write.mode("append").option("header", True).option("compression", "gzip").csv(root)
    fs, where = sf.place(root)
    one = max((f for f in fs.get_file_info(sf.pyarrow.fs.FileSelector(where)) if f.path.endswith(".gz")), key=lambda f: f.size)
    with fs.open_input_stream(one.path, compression=None) as whole, fs.open_output_stream(where + "/short.csv.gz", compression=None) as short:
        short.write(whole.read(one.size // 2))
    with fs.open_output_stream(where + "/plain.csv.gz", compression=None) as plain:
        plain.write(b"when,v,event_id\n2024-01-01 00:00:00,1.0,1\n")
    C = sf.ColumnSpec
    got = sf.ingest(v.spark, [sf.FileSpec(root, datetime="when", columns=(C("event_id", "event_id", "int"), C("v", "value")))])
    return got.rows.select("event_id", "ts", "value", got.files.agg(F.count(F.lit(1)).alias("n")).scalar().alias("broken"))


@query("A-08,A-10", "source_scan_range", views="readings", r="value",
       sql="SELECT ts, event_id, value FROM readings WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def _(v):
    path = st.save(st.with_date(v.readings), st.scratch(v.spark) + "/t", ["date"])
    return st.scan_range(v.spark, path, "2024-01-05 06:00:00", "2024-01-12 00:00:00", ["event_id", "value"])


@query("A-12", "source_upsert", views="readings", r="value", i="entity",
       sql="SELECT event_id, entity, CASE WHEN value > 30 THEN 0 ELSE value END AS value FROM readings UNION ALL SELECT event_id + 1000000000, entity, 1 FROM readings WHERE value > 60")
def _(v):
    path = st.save(st.with_date(v.readings).select("event_id", "entity", "value", "date"), st.scratch(v.spark) + "/t", ["date"])
    changed = st.with_date(v.readings).where("value > 30").select("event_id", "entity", F.lit(0.0).alias("value"), "date")
    added = st.with_date(v.readings).where("value > 60").select(F.col("event_id") + 1000000000, "entity", F.lit(1.0), "date")
    st.upsert(v.spark, path, changed.union(added), ["event_id"], ["date"])
    return v.spark.read.parquet(path).select("event_id", "entity", "value")


@query("A-01,A-05", "source_csv_mixed_headers", views="readings", r="value", i="entity",
       sql="SELECT event_id, entity, date_trunc('second', ts)::TIMESTAMP AS ts, value FROM readings")
def _(v):
    path = st.scratch(v.spark) + "/mixed"
    d = v.readings.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), "event_id", "entity", "value", "signal")
    for n, order in enumerate((["t", "event_id", "entity", "value"], ["value", "entity", "t", "event_id"], ["event_id", "value", "entity", "t"])):
        st.save_csv(d.where(F.col("event_id") % 3 == n).select(*order), f"{path}/{n}", sep=";")
    spec = sf.FileSpec([f"{path}/{n}" for n in range(3)], delimiter=";", datetime="t",
                       columns=(sf.ColumnSpec("event_id", "event_id", "int"), sf.ColumnSpec("entity", "entity", "int"), sf.ColumnSpec("value", "value")))
    return sf.read_csv(v.spark, spec).rows.select("event_id", "entity", "ts", "value")


@query("A-12", "source_upsert_moved", views="readings", r="value", i="entity",
       sql="""SELECT event_id, entity, CASE WHEN value > 30 OR event_id % 10 = 0 THEN 0 ELSE value END AS value,
       CASE WHEN value > 30 OR event_id % 10 = 0 THEN DATE '2030-01-01' ELSE CAST(ts AS DATE) END AS date FROM readings""")
def _(v):
    d = st.with_date(v.readings).select(F.when(F.col("event_id") == 0, None).otherwise(F.col("event_id")).alias("event_id"), "entity", "value", "date")
    path = st.save(d, st.scratch(v.spark) + "/t", ["date"])
    moved = d.where("value > 30 OR coalesce(event_id, 0) % 10 = 0").withColumns({"value": F.lit(0.0), "date": F.lit("2030-01-01").cast("date")})
    st.upsert(v.spark, path, moved, ["event_id"], ["date"])
    return v.spark.read.parquet(path).select(F.coalesce("event_id", F.lit(0).cast("long")).alias("event_id"), "entity", "value", "date")


@query("A-14", "source_insert_ignore_repeats", views="readings", r="value",
       sql="SELECT event_id, CASE WHEN value < 20 THEN value ELSE -value END AS value FROM readings")
def _(v):
    d = v.readings.select(F.when(F.col("event_id") == 0, None).otherwise(F.col("event_id")).alias("event_id"), "value")
    path = st.save(d.where("value < 20"), st.scratch(v.spark) + "/t")
    again = d.withColumn("value", -F.col("value"))
    st.insert_ignore(v.spark, path, again.unionAll(again).unionAll(again.withColumn("value", F.col("value") + 1)), ["event_id"])
    return v.spark.read.parquet(path).select(F.coalesce("event_id", F.lit(0).cast("long")).alias("event_id"), "value")


@query("A-13", "source_replace_slice", views="readings", r="value",
       sql="SELECT event_id, signal, CASE WHEN signal = 'click' THEN value * 2 ELSE value END AS value FROM readings")
def _(v):
    d = v.readings.select("event_id", "value", "signal", F.lit("A").alias("level"), F.lit("PELT").alias("stage"))
    path = st.save(d, st.scratch(v.spark) + "/t", ["signal", "level", "stage"])
    st.replace_slice(d.where("signal = 'click'").withColumn("value", F.col("value") * 2), path)
    return v.spark.read.parquet(path).select("event_id", "signal", "value")


@query("A-14", "source_insert_ignore", views="readings", r="value",
       sql="SELECT event_id, CASE WHEN value < 20 THEN value ELSE -value END AS value FROM readings")
def _(v):
    path = st.save(v.readings.where("value < 20").select("event_id", "value"), st.scratch(v.spark) + "/t")
    st.insert_ignore(v.spark, path, v.readings.select("event_id", (-F.col("value")).alias("value")), ["event_id"])
    return v.spark.read.parquet(path)


@query("A-15", "source_latest", views="readings", r="value",
       sql="SELECT entity, signal, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, signal ORDER BY ts DESC, event_id DESC) AS r FROM readings) WHERE r = 1")
def _(v):
    return latest_by(v.readings.select("entity", "signal", "ts", "event_id", "value"), ["entity", "signal"], ["ts", "event_id"])


@query("A-16,A-17", "source_stage", views="readings", i="rows columns",
       sql="SELECT 'stage1' AS stage, count(*) AS rows, 3 AS columns, min(ts) AS first_ts, max(ts) AS last_ts FROM readings")
def _(v):
    d = st.stage(v.readings.select("entity", "ts", "value"), "stage1")
    return st.stage_report(d, "stage1", "ts")


@query("A-18", "source_external", views="readings", r="price",
       sql="SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, signal AS area, avg(value) AS price FROM readings WHERE signal = 'view' AND ts < TIMESTAMP '2024-01-10 01:00:00' GROUP BY ALL")
def _(v):
    d = v.readings.groupBy(bucket("ts", "1h").alias("hour"), F.col("signal").alias("area")).agg(F.avg("value").alias("price"))
    path = st.save(d, st.scratch(v.spark) + "/prices")
    return st.read_external(v.spark, path, "2024-01-01 00:00:00", "2024-01-10 00:00:00", "hour", "view")


@query("A-19", "source_hourly_arrays", views="readings", r="temperature_2m",
       sql="SELECT entity, date_trunc('minute', ts)::TIMESTAMP AS time, value AS temperature_2m FROM readings")
def _(v):
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("t"), F.col("value").alias("x"), F.col("entity").cast("double").alias("e"))
    docs = v.readings.groupBy("entity").agg(F.collect_list(item).alias("a")).select(F.to_json(F.struct(F.struct(
        F.col("a.t").alias("time"), F.col("a.x").alias("temperature_2m"), F.col("a.e").alias("station")).alias("hourly"))).alias("doc"))
    return sf.parse_hourly_arrays(docs, "doc", ["temperature_2m", "station"]).select(
        F.col("station").cast("long").alias("entity"), "time", "temperature_2m")


@query("A-20", "source_write_features", views="readings", r="value", i="entity n",
       sql="SELECT entity, TIMESTAMP '2024-02-01 00:00:00' AS event_timestamp, DATE '2024-02-01' AS date, avg(value) AS value, count(*) AS n FROM readings GROUP BY entity")
def _(v):
    path = st.scratch(v.spark) + "/features"
    st.write_features(v.readings.groupBy("entity").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")), path, "2024-02-01")
    return v.spark.read.parquet(path).select("entity", "event_timestamp", "date", "value", "n")


@query("A-21", "source_flatten_groups", views="readings",
       sql="SELECT CAST(event_id AS VARCHAR) AS id, signal AS name FROM readings UNION ALL SELECT CAST(event_id + 5 AS VARCHAR), upper(signal) FROM readings WHERE value > 20")
def _(v):
    d = v.readings.select(F.col("event_id").cast("string").alias("a"), F.col("signal").alias("b"), F.lit("").alias("gap"),
                          F.when(F.col("value") > 20, (F.col("event_id") + 5).cast("string")).otherwise(" ").alias("c"), F.upper("signal").alias("d"))
    return sf.flatten_groups(d, 2, ["id", "name"], skip=1)


@query("A-22,A-25", "source_profile", views="readings_n", i="rows duplicate_times value_null",
       sql="""SELECT signal AS file, sum(n) AS rows, min(h) AS first_ts, max(h) AS last_ts, sum(n - 1) AS duplicate_times, sum(z) AS value_null FROM (
       SELECT signal, date_trunc('hour', ts)::TIMESTAMP AS h, count(*) AS n, count(*) FILTER (value IS NULL) AS z FROM readings_n GROUP BY ALL) GROUP BY signal""")
def _(v):
    path = st.save(v.readings_n.withColumn("h", bucket("ts", "1h")), st.scratch(v.spark) + "/t", ["signal"])
    d = v.spark.read.parquet(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "signal=([a-z]+)", 1))
    return sf.profile_files(d, "h", ["value"], "file")


@query("A-23", "source_presence", views="wide", sql="SELECT entity, count(click) > 0 AS click, count(purchase) > 0 AS purchase FROM wide GROUP BY entity")
def _(v):
    return sf.presence_matrix(v.wide, ["click", "purchase"], "entity")


@query("A-24", "source_reconcile", views="readings readings_n", i="source_rows table_rows difference",
       sql="SELECT signal, count(*) AS source_rows, count(*) FILTER (value <= 40) AS table_rows, count(*) FILTER (value > 40) AS difference FROM readings GROUP BY signal")
def _(v):
    return sf.reconcile_counts(v.readings, v.readings.where("value <= 40"), "signal")


@query("A-25", "source_file_metadata", views="lines", i="rows", sql="SELECT entity, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM lines GROUP BY entity")
def _(v):
    return sf.file_metadata(v.lines, "ts", "entity")


# ------------------------------------------------------------------------ streaming


def _stream(v, late="1 hour"):
    schema = v.table("events").schema
    return live.timed(live.read_files(v.spark, v.dir, schema, "events.parquet"), "ts", late)


def _hour_sql(size, slide):
    return f"""WITH w AS (SELECT signal, value, unnest(generate_series(((epoch_us(ts) - {size}) // {slide} + 1) * {slide}, (epoch_us(ts) // {slide}) * {slide}, {slide})) AS s FROM readings)
    SELECT signal AS event_type, make_timestamp(s) AS window_start, make_timestamp(s + {size}) AS window_end, avg(value) AS mean, min(value) AS min, max(value) AS max, count(value) AS count
    FROM w GROUP BY signal, s HAVING s + {size} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM readings)"""


@query("S-01", "stream_ingest", views="readings", r="value", sql="SELECT event_id, value FROM readings WHERE value <= 50")
def _(v):
    root = st.scratch(v.spark)
    live.ingest_to(_stream(v), F.col("value") <= 50, root + "/rows", root + "/rejects", root + "/cp").awaitTermination()
    return v.spark.read.parquet(root + "/rows").select("event_id", "value")


@query("S-02", "stream_hourly", views="readings", r="mean min max", i="count", sql=_hour_sql(3600000000, 3600000000))
def _(v):
    return _ntz(live.run_available(live.hourly(_stream(v), "value", "event_type"), st.scratch(v.spark)), "window_start", "window_end")


@query("S-03", "stream_sliding", views="readings", r="mean min max", i="count", sql=_hour_sql(86400000000, 21600000000))
def _(v):
    d = live.hourly(_stream(v), "value", "event_type", every="24 hours", slide="6 hours")
    return _ntz(live.run_available(d, st.scratch(v.spark)), "window_start", "window_end")


@query("S-04", "stream_islands", views="readings", i="rows",
       sql="""WITH g AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity ORDER BY ts)) >= 43200000000)::INT, 0) AS new FROM readings)),
       i AS (SELECT entity AS user_id, min(ts) AS start_time, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS rows FROM g GROUP BY entity, s)
       SELECT * FROM i WHERE epoch_us(session_end) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM readings)""")
def _(v):
    return _ntz(live.run_available(live.islands(_stream(v), "12 hours", "user_id"), st.scratch(v.spark)), "start_time", "session_end")


@query("S-05", "stream_state", views="readings", r="ewma", i="edges since",
       sql="""WITH o AS (SELECT event_id, entity, value, row_number() OVER (PARTITION BY entity ORDER BY ts) AS n FROM readings),
       r(entity, n, y, o, e, s) AS (SELECT entity, n, value, value > 20, 0, CASE WHEN value > 20 THEN 0 ELSE 1 END FROM o WHERE n = 1
       UNION ALL SELECT o.entity, o.n, 0.7 * r.y + 0.3 * o.value, o.value > 20, r.e + ((o.value > 20) <> r.o)::INT, CASE WHEN o.value > 20 THEN 0 ELSE r.s + 1 END FROM r JOIN o ON o.entity = r.entity AND o.n = r.n + 1)
       SELECT event_id, entity AS user_id, y AS ewma, e AS edges, s AS since FROM o JOIN r USING (entity, n)""")
def _(v):
    d = live.series_state(_stream(v).select("user_id", "ts", "event_id", "value"), "value", "user_id", ["ts", "event_id"])
    return live.run_available(d, st.scratch(v.spark)).select("event_id", "user_id", "ewma", "edges", "since")


#: Readings that two days of further ones have made final, numbered per entity; a gap of more than three days starts anew.
FINAL = """o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS n,
    epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity ORDER BY ts, event_id)) > 259200000000 AS anew,
    epoch_us(ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 172800000000 FROM readings) AS final FROM readings)"""


def _two_batches(v, build):
    """The events in two batches whose times overlap by a day, the second one after a restart of the stream."""
    root, events = st.scratch(v.spark), v.table("events")
    middle = events.agg(((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2).alias("m")).scalar()
    moved = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod("event_id", F.lit(24)) * 3_600_000_000
    for early in (True, False):
        events.where((moved < middle) if early else ~(moved < middle)).write.mode("append").parquet(root + "/in")
        stream = live.timed(live.read_files(v.spark, root + "/in", events.schema), "ts", "2 days")
        with live.state_store(v.spark):
            out = live.run_available(build(stream), root)
    return out


@query("S-05", "stream_smoothed_in_order", views="readings", r="ewma", i="edges since",
       sql=f"""WITH {FINAL}, r(entity, n, y, o, e, s) AS (SELECT entity, n, value, value > 20, 0, CASE WHEN value > 20 THEN 0 ELSE 1 END FROM o WHERE n = 1
       UNION ALL SELECT o.entity, o.n, CASE WHEN o.anew THEN o.value ELSE 0.7 * r.y + 0.3 * o.value END, o.value > 20, CASE WHEN o.anew THEN 0 ELSE r.e + ((o.value > 20) <> r.o)::INT END,
         CASE WHEN o.value > 20 THEN 0 WHEN o.anew THEN 1 ELSE r.s + 1 END FROM r JOIN o ON o.entity = r.entity AND o.n = r.n + 1)
       SELECT event_id, entity AS user_id, y AS ewma, e AS edges, s AS since FROM o JOIN r USING (entity, n) WHERE final""")
def _(v):
    return _two_batches(v, lambda d: live.smoothed_in_order(d, "value", "user_id", ["ts", "event_id"], idle="3 days")).drop("ts")


@query("S-05,W-16", "stream_holt", views="readings", r="level trend",
       sql=f"""WITH {FINAL}, r(entity, n, l, t) AS (SELECT entity, n, value, 0.0::DOUBLE FROM o WHERE n = 1
       UNION ALL SELECT o.entity, o.n, 0.4 * o.value + 0.6 * (r.l + r.t), 0.3 * (0.4 * o.value + 0.6 * (r.l + r.t) - r.l) + 0.7 * r.t FROM r JOIN o ON o.entity = r.entity AND o.n = r.n + 1)
       SELECT event_id, entity AS user_id, l AS level, t AS trend FROM o JOIN r USING (entity, n) WHERE final""")
def _(v):
    return _two_batches(v, lambda d: live.holt(d, "value", "user_id", ["ts", "event_id"])).drop("ts")


PRIOR = "{'m': %s::DOUBLE, 'mu': 0.0::DOUBLE, 'k': 1.0::DOUBLE, 'a': 1.0::DOUBLE, 'b': 1.0::DOUBLE}"


@query("S-05,E-07", "stream_bocpd", views="readings", r="cp_prob",
       sql=f"""WITH {FINAL}, r AS (SELECT entity, 0::BIGINT AS n, 0.0::DOUBLE AS cp_prob, [{PRIOR % 1.0}] AS s FROM o WHERE n = 1
        UNION ALL SELECT entity, n, CASE WHEN n > 1 THEN w[1] / list_sum(w) ELSE 0.0 END,
            list_concat([{PRIOR % 0.01}], list_transform(s, lambda q, i: {{'m': w[i] / list_sum(w), 'mu': (q.k * q.mu + v) / (q.k + 1), 'k': q.k + 1, 'a': q.a + 0.5, 'b': q.b + q.k * (v - q.mu) ** 2 / (2 * (q.k + 1))}}))
        FROM (SELECT o.entity, o.n, o.value AS v, r.s, list_transform(r.s, lambda q, i: q.m * CASE WHEN i = 1 THEN 1.0 ELSE 0.99 END
                * exp(lgamma(q.a + 0.5) - lgamma(q.a) - 0.5 * ln(2 * pi() * q.b * (q.k + 1) / q.k) - (q.a + 0.5) * ln(1 + (o.value - q.mu) ** 2 / (2 * q.b * (q.k + 1) / q.k)))) AS w
              FROM r JOIN o ON o.entity = r.entity AND o.n = r.n + 1))
       SELECT event_id, entity AS user_id, cp_prob FROM o JOIN r USING (entity, n) WHERE final""")
def _(v):
    return _two_batches(v, lambda d: live.bocpd(d, "value", "user_id", ["ts", "event_id"], lam=100.0)).drop("ts")


@query("S-06", "stream_dedupe", views="readings", sql="SELECT entity AS user_id, signal AS event_type, count(*) AS n FROM readings GROUP BY ALL")
def _(v):
    d = _stream(v).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = live.run_available(live.distinct_events(d, "event_id").select("event_id", "user_id", "event_type"), st.scratch(v.spark))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("S-07,J-01", "stream_join_static", views="readings price", r="value price",
       sql="SELECT event_id, value, price FROM readings LEFT JOIN price ON date_trunc('hour', ts)::TIMESTAMP = hour")
def _(v):
    d = _stream(v).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return live.run_available(live.join_static(d, v.price, "hour").select("event_id", "value", "price"), st.scratch(v.spark))


@query("S-07", "stream_join_live", views="readings", r="a b",
       sql="""SELECT x.event_id, x.value AS a, y.value AS b FROM readings x JOIN readings y ON x.entity = y.entity AND x.ts >= y.ts AND x.ts <= y.ts + INTERVAL 6 HOUR AND x.signal = 'click' AND y.signal = 'view'""")
def _(v):
    a = _stream(v).where("event_type = 'click'").select("event_id", "user_id", "ts", F.col("value").alias("a"))
    b = _stream(v).where("event_type = 'view'").select(F.col("user_id").alias("who"), F.col("ts").alias("at"), F.col("value").alias("b"))
    d = live.join_live(a, b, "ts", "at", {"user_id": "who"}, "6 HOURS").select("event_id", "a", "b")
    return live.run_available(d, st.scratch(v.spark))
