"""Cleaning, filtering, deduplication."""

from pyspark.sql import functions as F

from ...functions import clean as fc
from ...operators import clean as oc
from ..registry import query

TEXT = ("CASE event_id % 13 WHEN 0 THEN 'NaN' WHEN 1 THEN '-999' WHEN 2 THEN '' WHEN 3 THEN 'N/A' "
        "WHEN 4 THEN 'on' WHEN 5 THEN ' OFF ' WHEN 6 THEN '-' WHEN 7 THEN '42' WHEN 8 THEN '7,0' "
        "WHEN 9 THEN 'maybe' WHEN 10 THEN '7.5' ELSE replace(CAST(value AS VARCHAR), '.', ',') END")


def _text(v):
    """Every reading as messy text, as a CSV export would hold it."""
    return v.readings.withColumn("raw", F.expr(TEXT.replace("VARCHAR", "STRING")))


@query("C-01", "clean_null_markers", views="readings", i="n n_null n_false",
       sql=f"""SELECT signal, count(*) AS n, count(*) FILTER (raw IN ('', 'NaN', 'NULL', 'N/A', '-1', '-999')) AS n_null,
       count(*) FILTER (raw IN ('', 'NaN', 'NULL', 'N/A', '-1', '-999')) AS n_false
       FROM (SELECT *, {TEXT} AS raw FROM readings) GROUP BY signal""")
def _(v):
    markers = (*fc.NULL_MARKERS, "-1", "-999")  # a file's own list
    return _text(v).groupBy("signal").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fc.null_markers("raw", markers).isNull()).alias("n_null"),
        F.count_if(fc.null_markers("raw", markers, boolean=True) == "false").alias("n_false"))


@query("C-03,C-04,C-05", "clean_parse", views="readings", r="number",
       sql=f"""SELECT event_id, TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE) AS number,
       CASE WHEN TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE) IS NULL OR isnan(TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE)) THEN NULL
         WHEN abs(TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE) - round(TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE))) < 1e-9
         THEN round(TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE))::BIGINT END AS whole,
       CASE WHEN lower(trim(raw)) IN ('true','1','yes','t','y','on') THEN TRUE
            WHEN lower(trim(raw)) IN ('', 'false','0','no','f','n','off','-','–') THEN FALSE END AS flag
       FROM (SELECT *, CASE WHEN {TEXT} = 'NaN' THEN NULL ELSE {TEXT} END AS raw FROM readings)""")
def _(v):
    t = _text(v).withColumn("raw", F.when(F.col("raw") != "NaN", F.col("raw")))
    return t.select("event_id", fc.parse_decimal("raw").alias("number"), fc.parse_int("raw").alias("whole"),
                    fc.parse_bool("raw").alias("flag"))


@query("C-02,C-30", "clean_nonfinite", views="readings", r="value zeroed",
       sql="""SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS value,
       CASE WHEN event_id % 5 > 1 THEN value ELSE 0 END AS zeroed FROM readings""")
def _(v):
    messy = F.expr("CASE event_id % 5 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE value END")
    d = v.readings.withColumn("m", messy)
    return d.select("event_id", fc.finite("m").alias("value"), fc.finite_or_zero("m").alias("zeroed"))


@query("C-06,C-07,C-12", "clean_ranges", views="readings_n", r="ranged plain",
       sql="""SELECT event_id, CASE WHEN value > 0 AND value < 60 THEN value END AS ranged,
       CASE WHEN value <> -1 THEN value END AS plain FROM readings_n""")
def _(v):
    d = v.readings_n.withColumns({"ranged": F.col("value"), "plain": F.col("value")})
    d = oc.apply_ranges(d, {"ranged": (0.0, 60.0)}, open_low=True, open_high=True)
    return oc.apply_sentinels(d, {"plain": [-1.0]}).select("event_id", "ranged", "plain")


MESSY = "CASE event_id % 4 WHEN 0 THEN '#NUM!' WHEN 1 THEN '9e99' WHEN 2 THEN '' ELSE CAST(value AS VARCHAR) END"


@query("C-08", "clean_export", views="readings", r="value",
       sql=f"""SELECT event_id, coalesce(TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE), 0) AS value
       FROM (SELECT event_id, {MESSY} AS raw FROM readings) WHERE raw <> '#NUM!' AND coalesce(abs(TRY_CAST(raw AS DOUBLE)) <= 1e30, TRUE)""")
def _(v):
    d = v.readings.withColumn("value", F.expr(MESSY.replace("VARCHAR", "STRING")))
    return oc.clean_export(d, ["value"]).select("event_id", "value")


@query("C-09", "clean_clip", views="readings_n", r="value",
       sql="""SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, 1), 50) END AS value FROM readings_n""")
def _(v):
    return oc.clip_outliers(v.readings_n, {"value": (1.0, 50.0), "event_id": (0, 1)}, skip=["event_id"]).select("event_id", "value")


@query("C-09,Q-06", "clean_clip_counts", views="readings_n", i="low high",
       sql="""SELECT 'value' AS "column", count(*) FILTER (value < 1) AS low, count(*) FILTER (value > 50) AS high FROM readings_n""")
def _(v):
    return oc.clip_counts(v.readings_n, {"value": (1.0, 50.0)})


QUARTILES = """q AS (SELECT signal, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM readings_n GROUP BY signal)"""


@query("C-10", "clean_iqr", views="readings_n", r="nulled clipped",
       sql=f"""WITH {QUARTILES} SELECT event_id,
       CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END AS nulled,
       CASE WHEN value IS NOT NULL THEN least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS clipped
       FROM readings_n JOIN q USING (signal)""")
def _(v):
    d = v.readings_n.select("event_id", "signal", F.col("value").alias("nulled"), F.col("value").alias("clipped"))
    d = oc.iqr_outliers(d, "nulled", "signal", chunk=v.split("signal"))
    return oc.iqr_outliers(d, "clipped", "signal", strategy="clip", chunk=v.split("signal")).select("event_id", "nulled", "clipped")


@query("C-11", "clean_rolling_z", views="readings_n",
       sql="""SELECT event_id, coalesce(n >= 3 AND s > 0 AND abs(value - m) > 1.2 * s, FALSE) AS outlier FROM (
       SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev(value) OVER w AS s FROM readings_n
       WINDOW w AS (PARTITION BY entity, signal ORDER BY epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW))""")
def _(v):
    return oc.rolling_z_outliers(v.readings_n, "value", ["entity", "signal"], "7 days", 1.2, 3).select("event_id", "outlier")


@query("C-13,C-15", "clean_rules", views="readings_n", r="value mad",
       sql=f"""WITH {QUARTILES}, med AS (SELECT signal, median(value) AS m FROM readings_n GROUP BY signal),
       mad AS (SELECT signal, m, median(abs(value - m)) AS d FROM readings_n JOIN med USING (signal) GROUP BY signal, m),
       dom AS (SELECT event_id, signal, value AS original, CASE WHEN value >= 0 AND value <= 200 THEN value END AS v FROM readings_n)
       SELECT event_id, CASE WHEN v BETWEEN q1 - 2 * (q3 - q1) AND q3 + 2 * (q3 - q1) THEN v END AS value,
       CASE WHEN original BETWEEN m - 3 * 1.4826 * d AND m + 3 * 1.4826 * d THEN original END AS mad
       FROM dom JOIN q USING (signal) JOIN mad USING (signal)""")
def _(v):
    R = oc.OutlierRule
    d = v.readings_n.withColumn("mad", F.col("value"))
    rules = [R("value", "domain", low=0.0, high=200.0), R("value", "iqr", factor=2.0), R("mad", "mad", factor=3.0)]
    return oc.apply_outlier_rules(d, rules, "signal", chunk=v.split("signal")).select("event_id", "value", "mad")


@query("C-15", "clean_winsorize", views="readings_n", r="value",
       sql="""WITH q AS (SELECT signal, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM readings_n GROUP BY signal)
       SELECT event_id, CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END AS value FROM readings_n JOIN q USING (signal)""")
def _(v):
    return oc.apply_outlier_rules(v.readings_n, [oc.OutlierRule("value", "winsorize")], "signal", chunk=v.split("signal")).select("event_id", "value")


@query("C-14", "clean_suggest_bounds", views="lines", r="low high",
       sql="""WITH l AS (SELECT 'temp' AS "column", temp AS v FROM lines UNION ALL SELECT 'light', light FROM lines),
       q AS (SELECT "column", quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75,
             quantile_cont(v, 0.99) AS p99, min(v) AS lo, max(v) AS hi FROM l GROUP BY ALL)
       SELECT "column", greatest(least(p01, p25 - 1.5 * (p75 - p25)), lo, CASE WHEN "column" = 'temp' THEN 5 ELSE -1e300 END) AS low,
       least(greatest(p99, p75 + 1.5 * (p75 - p25)), hi, CASE WHEN "column" = 'temp' THEN 45 ELSE 1e300 END) AS high FROM q""")
def _(v):
    return oc.suggest_bounds(v.lines, ["temp", "light"], {"temp": (5.0, 45.0)}, chunk=v.spread(of="lines"))


@query("C-16,C-17", "clean_recode", views="readings",
       sql="""SELECT event_id, CASE WHEN s = 0 THEN 0 WHEN s > 0 AND s <= 1 THEN 1 END AS status, (event_id % 2 = 0)::INT AS flag
       FROM (SELECT event_id, (event_id % 9 - 3) / 4.0 AS s FROM readings)""")
def _(v):
    d = v.readings.withColumn("s", (F.col("event_id") % 9 - 3) / 4.0)
    return d.select("event_id", fc.recode_status("s").alias("status"), fc.bool_to_int(F.col("event_id") % 2 == 0).alias("flag"))


STAMP = "CASE WHEN event_id % 6 = 0 THEN 'not a time' ELSE CAST(ts AS VARCHAR) END"


@query("C-18,C-19", "clean_prepare_time", views="readings", i="n",
       sql=f"""SELECT '1' AS entity, date_trunc('day', TRY_CAST(raw AS TIMESTAMP))::TIMESTAMP AS day, count(*) AS n
       FROM (SELECT {STAMP} AS raw FROM readings) WHERE TRY_CAST(raw AS TIMESTAMP) IS NOT NULL GROUP BY ALL""")
def _(v):
    raw = v.readings.select(F.expr(STAMP.replace("VARCHAR", "STRING")).alias("raw"))
    d = oc.ensure_entity(oc.prepare_time(raw, "raw"))
    return d.groupBy("entity", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("C-20", "clean_dedupe_first", views="readings", r="value",
       sql="""SELECT entity, ts, event_id, value FROM (SELECT entity, date_trunc('hour', ts)::TIMESTAMP AS ts, event_id, value,
       row_number() OVER (PARTITION BY entity, date_trunc('hour', ts) ORDER BY event_id) AS r FROM readings) WHERE r = 1""")
def _(v):
    d = v.readings.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")).select("entity", "ts", "event_id", "value")
    return oc.dedupe_first(d, ["entity", "ts"], "event_id")


@query("C-21,W-26", "clean_latest_in_minute", views="readings", r="value",
       sql="""SELECT signal, bucket, ts, event_id, value FROM (SELECT signal, date_trunc('minute', ts)::TIMESTAMP AS bucket, ts, event_id, value,
       row_number() OVER (PARTITION BY signal, date_trunc('minute', ts) ORDER BY ts DESC, event_id DESC) AS r FROM readings) WHERE r = 1""")
def _(v):
    return oc.latest_per_bucket(v.readings.select("signal", "ts", "event_id", "value"), "signal", "1 minute", tie=["event_id"])


@query("C-22", "clean_dedupe_mean", views="lines", r="temp rh",
       sql="SELECT entity, ts, avg(temp) AS temp, avg(rh) AS rh FROM lines GROUP BY ALL")
def _(v):
    return oc.dedupe_mean(v.lines, "entity", ["temp", "rh"])


@query("C-24,C-25", "clean_select_columns", views="wide", r="click view",
       sql="SELECT entity, hour, view, click FROM wide")
def _(v):
    d = oc.select_signals(v.wide, ["click", "purchase", "view"], keep=["entity", "hour"])
    return oc.select_by_coverage(d, ["click", "purchase", "view"], 0.05, ["view", "click"], 2, keep=["entity", "hour"])


@query("C-25", "clean_column_coverage", views="wide", r="coverage",
       sql="""SELECT unnest(['click','view']) AS "column", unnest([count(click) / count(*), count(view) / count(*)]) AS coverage FROM wide""")
def _(v):
    return oc.column_coverage(v.wide, ["click", "view"])


@query("C-26,C-27", "clean_viable_hours", views="wide", r="coverage", i="n",
       sql="""SELECT entity, hour, coverage, n FROM (SELECT entity, hour,
       ((click IS NOT NULL)::INT + (error IS NOT NULL)::INT + (purchase IS NOT NULL)::INT + (signup IS NOT NULL)::INT + (view IS NOT NULL)::INT) AS n,
       n / 5 AS coverage FROM wide) WHERE coverage > 0.2 AND n > 0""")
def _(v):
    n = sum((F.col(s).isNotNull().cast("int") for s in ("click", "error", "purchase", "signup", "view")), F.lit(0))
    d = v.wide.withColumn("n", n).withColumn("coverage", F.col("n") / 5)
    return oc.drop_empty(oc.viable(d, "coverage", 0.2)).select("entity", "hour", "coverage", "n")


@query("C-28", "clean_physics", views="readings", r="value",
       sql="""SELECT event_id, CASE WHEN value BETWEEN 1 AND 90 AND coalesce(abs(value - lag(value) OVER (PARTITION BY entity, signal ORDER BY ts)) <= 30, TRUE)
       THEN value END AS value FROM readings""")
def _(v):
    return oc.physics_check(v.readings, "value", ["entity", "signal"], 1.0, 90.0, 30.0, chunk=v.split("entity", "signal")).select("event_id", "value")


@query("C-29,C-32", "clean_availability_flags", views="wide",
       sql="SELECT entity, hour, (click IS NOT NULL)::INT AS click_is_available, (view IS NOT NULL)::INT AS view_is_available FROM wide")
def _(v):
    return oc.availability_flags(v.wide, ["click", "view"]).drop("click", "view", "error", "purchase", "signup")


@query("C-31", "clean_decimate", views="readings",
       sql="""SELECT event_id FROM readings JOIN (SELECT entity, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM readings GROUP BY entity) USING (entity)
       WHERE span < 2500000000000 OR floor(epoch_us(ts) / 1000000)::BIGINT % 60 = 0""")
def _(v):
    return oc.decimate(v.readings, "2500000 seconds", "60 seconds", "entity").select("event_id")
