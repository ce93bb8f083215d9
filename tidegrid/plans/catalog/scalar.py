"""Scalar functions: calendar, JSON, psychrometrics, scores."""

from pyspark.sql import functions as F

from ...frames import cols
from ...functions import calendar as cal
from ...functions import climate as cl
from ...functions import jsonx, scores
from ...operators import agg
from ..registry import query


@query("F-01", "scalar_time_parts", views="readings", i="hour weekday day month year day_of_year week",
       sql="""SELECT event_id, hour(ts) AS hour, isodow(ts) AS weekday, day(ts) AS day, month(ts) AS month, year(ts) AS year,
       dayofyear(ts) AS day_of_year, weekofyear(ts) AS week FROM readings""")
def _(v):
    return v.readings.select("event_id", *[c.alias(n) for n, c in cal.time_parts("ts").items()])


@query("F-02", "scalar_cycles", views="readings", r="hour_sin hour_cos weekday_sin weekday_cos month_sin month_cos",
       sql="""SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
       sin(2 * pi() * (isodow(ts) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS weekday_cos,
       sin(2 * pi() * month(ts) / 12) AS month_sin, cos(2 * pi() * month(ts) / 12) AS month_cos FROM readings""")
def _(v):
    return v.readings.select("event_id", *[c.alias(n) for n, c in cal.cyclic_parts("ts").items()])


@query("F-03,F-04", "scalar_truncate", views="readings", i="ms",
       sql="""SELECT event_id, date_trunc('minute', ts)::TIMESTAMP AS minute, date_trunc('hour', ts)::TIMESTAMP AS hour,
       date_trunc('day', ts)::TIMESTAMP AS day, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS back FROM readings""")
def _(v):
    return v.readings.select("event_id", *[cal.trunc(u, "ts").alias(u) for u in ("minute", "hour", "day")],
                             cal.to_millis("ts").alias("ms"), cal.from_millis(cal.to_millis("ts")).alias("back"))


@query("F-05", "scalar_json_field", views="readings", r="k nothing",
       sql="""SELECT event_id, (props->>'$.k')::DOUBLE AS k, (props->>'$.absent')::DOUBLE AS nothing FROM readings""")
def _(v):
    return v.readings.select("event_id", jsonx.field("props", "k").alias("k"), jsonx.field("props", "absent").alias("nothing"))


@query("F-06", "scalar_json_explode", views="readings", r="number",
       sql="""SELECT entity, signal, 'k' AS name, max((props->>'$.k')::DOUBLE) AS number FROM readings GROUP BY ALL""")
def _(v):
    long = jsonx.explode_fields(v.readings, "props", ["entity", "signal"])
    back = jsonx.collect_fields(long, ["entity", "signal"], "name", "number")
    return back.select("entity", "signal", F.explode("features").alias("name", "number"))


@query("F-07,A-21", "scalar_melt", views="wide", r="value",
       sql="""SELECT entity, hour, signal, value FROM (UNPIVOT wide ON click, error, purchase, signup, view INTO NAME signal VALUE value)""")
def _(v):
    return agg.melt(v.wide, ["entity", "hour"], ["click", "error", "purchase", "signup", "view"], "signal", "value")


@query("F-08", "scalar_pivot", views="readings", r="Day Night",
       sql="""SELECT entity, date_trunc('day', ts)::TIMESTAMP AS date, avg(value) FILTER (hour(ts) >= 6 AND hour(ts) < 18) AS "Day",
       avg(value) FILTER (NOT (hour(ts) >= 6 AND hour(ts) < 18)) AS "Night" FROM readings GROUP BY ALL""")
def _(v):
    d = v.readings.select("entity", cal.trunc("day", "ts").alias("date"), cal.day_night(cal.is_day_fixed("ts")).alias("period"), "value")
    return agg.pivot(d, ["entity", "date"], "period", ["Day", "Night"], "value")


@query("F-09", "scalar_split_core", views="wide", r="click",
       sql="""SELECT entity, hour, click, '{' || concat_ws(',', CASE WHEN error IS NOT NULL THEN '"error":1.0' END,
       CASE WHEN view IS NOT NULL THEN '"view":2.0' END) || '}' AS extended FROM wide""")
def _(v):
    m = F.map_filter(F.create_map(F.lit("click"), F.col("click"), F.lit("error"), F.when(F.col("error").isNotNull(), 1.0),
                                  F.lit("view"), F.when(F.col("view").isNotNull(), 2.0)), lambda _, x: x.isNotNull())
    return v.wide.withColumn("m", m).select("entity", "hour", *[c.alias(n) for n, c in jsonx.split_core("m", ["click"]).items()])


@query("F-10,A-22", "scalar_flatten_maps", views="wide", r="number",
       sql="""SELECT entity, hour, 'a_click' AS name, click AS number FROM wide WHERE click IS NOT NULL
       UNION ALL SELECT entity, hour, 'b_click', click * 2 FROM wide WHERE click IS NOT NULL""")
def _(v):
    d = v.wide.withColumns({"a": F.create_map(F.lit("click"), F.col("click")), "b": F.create_map(F.lit("click"), F.col("click") * 2)})
    return d.select("entity", "hour", F.explode(jsonx.flatten_maps(["a", "b"])).alias("name", "number")).where("number IS NOT NULL")


@query("U-04", "scalar_key_universe", views="readings", sql="SELECT 'k' AS name")
def _(v):
    return jsonx.key_universe(v.readings, "props")


@query("F-11,F-13", "scalar_strings", views="readings",
       sql="""SELECT event_id, upper(trim(signal)) AS up, contains(lower(signal), 'up') AS has_up, starts_with(signal, 'c') AS first_c,
       signal || '_A_PELT_' || entity AS era_key, split_part(signal, 'i', 1) AS head FROM readings""")
def _(v):
    s = F.col("signal")
    return v.readings.select("event_id", F.upper(F.trim(s)).alias("up"), F.lower(s).contains("up").alias("has_up"),
                             s.startswith("c").alias("first_c"),
                             scores.era_key("signal", F.lit("A"), F.lit("PELT"), "entity").alias("era_key"),
                             F.split_part(s, F.lit("i"), F.lit(1)).alias("head"))


@query("F-12", "scalar_category",
       sql="""SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' THEN 'growth' WHEN p_name LIKE '%ring%' THEN 'morphology'
       WHEN p_name LIKE '%flower%' OR p_name LIKE '%gear%' THEN 'flowering' ELSE 'other' END AS category FROM part""")
def _(v):
    rules = {"growth": ("%bolt%",), "morphology": ("%ring%",), "flowering": ("%flower%", "%gear%")}
    return v.table("part").select("p_partkey", scores.category("p_name", rules).alias("category"))


KEY = "orderkey, line, entity, ts"
ES = "0.6108 * exp(17.27 * temp / (temp + 237.3))"
DEW = "237.3 * (17.27 * temp / (237.3 + temp) + ln(rh / 100)) / (17.27 - (17.27 * temp / (237.3 + temp) + ln(rh / 100)))"


@query("F-14,F-15", "climate_vpd", views="lines", r="svp vpd",
       sql=f"""SELECT {KEY}, temp, rh, 0.61078 * exp(17.27 * temp / (temp + 237.3)) AS svp,
       greatest(0, 0.61078 * exp(17.27 * temp / (temp + 237.3)) * (1 - rh / 100)) AS vpd FROM lines""")
def _(v):
    return v.lines.select(*cols(KEY.split(", ")), "temp", "rh", cl.saturation_pressure("temp").alias("svp"), cl.vpd("temp", "rh").alias("vpd"))


@query("F-16,F-17,F-22", "climate_dew_wet", views="lines", r="dew wet risk",
       sql=f"""SELECT {KEY}, {DEW} AS dew, temp * atan(0.151977 * sqrt(rh + 8.313659)) + atan(temp + rh) - atan(rh - 1.676331)
       + 0.00391838 * pow(rh, 1.5) * atan(0.023101 * rh) - 4.686035 AS wet,
       CASE WHEN temp - 2 - {DEW} <= 0 THEN 1 WHEN temp - 2 - {DEW} >= 5 THEN 0 ELSE 1 - (temp - 2 - {DEW}) / 5 END AS risk FROM lines""")
def _(v):
    return v.lines.select(*KEY.split(", "), cl.dew_point("temp", "rh").alias("dew"), cl.wet_bulb("temp", "rh").alias("wet"),
                          cl.condensation_risk(F.col("temp") - 2, "temp", "rh").alias("risk"))


@query("F-18,F-19,F-20,F-21", "climate_moist_air", views="lines", r="ratio enthalpy volume bowen",
       sql=f"""SELECT {KEY}, w AS ratio, 1.006 * temp + w * (2501 + 1.86 * temp) AS enthalpy,
       0.287042 * (temp + 273.15) * (1 + 1.6078 * w) / 101.325 AS volume,
       CASE WHEN leaf - es * rh / 100 > 0.001 THEN 0.0665 * (1.5 - temp * 0.1) / (leaf - es * rh / 100) ELSE 0 END AS bowen
       FROM (SELECT *, {ES} AS es, 0.6108 * exp(17.27 * (temp * 0.9 + 1.5) / (temp * 0.9 + 1.5 + 237.3)) AS leaf,
       0.621945 * {ES} * rh / 100 / (101.325 - {ES} * rh / 100) AS w FROM lines)""")
def _(v):
    w = cl.humidity_ratio("temp", "rh")
    return v.lines.select(*KEY.split(", "), w.alias("ratio"), cl.enthalpy("temp", w).alias("enthalpy"),
                          cl.specific_volume("temp", w).alias("volume"),
                          cl.bowen_ratio("temp", "rh", F.col("temp") * 0.9 + 1.5).alias("bowen"))


@query("F-23,F-24", "climate_deltas", views="lines", r="delta co2_gap from_mid",
       sql=f"""SELECT {KEY}, temp - light / 100 AS delta, co2 - 900 AS co2_gap, temp - 22 AS from_mid, (temp BETWEEN 20 AND 24)::INT AS in_range FROM lines""")
def _(v):
    return v.lines.select(*KEY.split(", "), scores.delta("temp", F.col("light") / 100).alias("delta"), scores.delta("co2", F.lit(900.0)).alias("co2_gap"),
                          scores.from_midpoint("temp", 20, 24).alias("from_mid"), scores.in_range_flag("temp", 20, 24).alias("in_range"))


@query("F-25,F-26", "climate_night_stress", views="readings_n",
       sql="""SELECT event_id, CASE WHEN hour(ts) >= 6 AND hour(ts) < 18 THEN 'Day' ELSE 'Night' END AS period,
       CASE WHEN event_id % 2 = 1 OR event_id % 3 = 1 THEN 'Day' ELSE 'Night' END AS lamp_period,
       coalesce((NOT (hour(ts) >= 6 AND hour(ts) < 18) AND value > 25)::INT, 0) AS hot_night,
       coalesce((NOT (hour(ts) >= 6 AND hour(ts) < 18) AND value < 10)::INT, 0) AS cold_night FROM readings_n""")
def _(v):
    day = cal.is_day_fixed("ts")
    d = v.readings_n.withColumns({"lamp1": F.col("event_id") % 2, "lamp2": F.when(F.col("event_id") % 3 == 1, 1)})
    return d.select("event_id", cal.day_night(day).alias("period"), cal.day_night(cal.is_day_lamps(["lamp1", "lamp2"])).alias("lamp_period"),
                    scores.night_stress("value", day, 25).alias("hot_night"), scores.night_stress("value", day, 10, "low").alias("cold_night"))


@query("F-27", "scale_minmax", views="lines", r="temp light",
       sql="""SELECT orderkey, line, entity, ts, 2 * (temp - t0) / nullif(t1 - t0, 0) - 1 AS temp, 2 * (light - l0) / nullif(l1 - l0, 0) - 1 AS light
       FROM lines, (SELECT min(temp) AS t0, max(temp) AS t1, min(light) AS l0, max(light) AS l1 FROM lines)""")
def _(v):
    fitted = agg.fit_minmax(v.lines, ["temp", "light"])
    return agg.apply_minmax(v.lines, fitted, ["temp", "light"]).select(*KEY.split(", "), "temp", "light")


@query("F-28,F-29,F-30", "light_lamps", views="lines", r="ppf kw total",
       sql=f"""SELECT {KEY}, (line % 2 = 1)::INT + (line > 3)::INT AS lamps, 100.0 * 2 * (line % 2 = 1)::INT + 50 * 4 * (line > 3)::INT AS ppf,
       0.6 * 2 * (line % 2 = 1)::INT + 0.3 * 4 * (line > 3)::INT AS kw, light + 100.0 * 2 * (line % 2 = 1)::INT + 50 * 4 * (line > 3)::INT AS total FROM lines""")
def _(v):
    d = v.lines.withColumns({"g1": F.when(F.col("line") % 2 == 1, 1), "g2": (F.col("line") > 3).cast("int")})
    ppf = cl.lamp_output({"g1": (100.0, 2), "g2": (50.0, 4)})
    return d.select(*KEY.split(", "), cl.lamps_on(["g1", "g2"]).alias("lamps"), ppf.alias("ppf"),
                    cl.lamp_output({"g1": (0.6, 2), "g2": (0.3, 4)}).alias("kw"), cl.total_ppfd("light", ppf).alias("total"))


HOURS = "(hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0)"
GAMMA = f"(2 * pi() / 365 * (dayofyear(ts) - 1 + ({HOURS} - 12) / 24))"
ELEV = ("(sin(radians(56.2661)) * sin(d) + cos(radians(56.2661)) * cos(d) * cos(radians((h * 60 + e + 4 * 10.064) / 4 - 180)))")


@query("F-31", "light_clear_sky", views="readings", r="ghi par",
       sql=f"""SELECT event_id, CASE WHEN s > 0.001 THEN 1098 * s * exp(-0.057 / s) ELSE 0 END AS ghi,
       4.57 * CASE WHEN s > 0.001 THEN 1098 * s * exp(-0.057 / s) ELSE 0 END AS par FROM (SELECT event_id, {ELEV} AS s FROM (
       SELECT event_id, {HOURS} AS h,
       229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS e,
       0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g)
       + 0.00148 * sin(3 * g) AS d FROM (SELECT *, {GAMMA} AS g FROM readings)))""")
def _(v):
    return v.readings.select("event_id", scores.clear_sky_irradiance("ts", 56.2661, 10.064).alias("ghi"),
                             scores.clear_sky_par("ts", 56.2661, 10.064).alias("par"))


@query("F-33", "score_objectives", views="lines", r="growth sustainability energy_cost growth_rate stress",
       sql=f"""SELECT {KEY}, g AS growth, 0.4 * g + 0.3 * c + 0.3 * least(light / 500, 1) AS sustainability, 1 - c AS energy_cost, g AS growth_rate,
       1 - least(temp / 40, 1) AS stress FROM (SELECT *, temp / 50 * least(light / 300, 1) AS g, (rh - 40) / 50 AS c FROM lines)""")
def _(v):
    g = scores.growth_score(F.col("temp") / 50, F.col("light") / 300)
    d = v.lines.withColumns({"growth": g, "c": (F.col("rh") - 40) / 50})
    return d.select(*KEY.split(", "), "growth", scores.sustainability("growth", "c", F.col("light") / 500).alias("sustainability"),
                    *[x.alias(n) for n, x in scores.objective_triple("growth", "c", F.col("temp") / 40).items()])


@query("F-34,F-35,F-36", "score_candidates", views="solutions", r="objective rounded",
       sql="""SELECT sol, 0.7 * f1 - 0.3 * f2 AS objective, coalesce(f1 <= 950, FALSE) AS f1_ok, coalesce(f2 >= 5 AND f2 <= 40, FALSE) AS f2_ok,
       coalesce(f1 <= 950, FALSE) AND coalesce(f2 >= 5 AND f2 <= 40, FALSE) AS feasible, round(least(greatest(f1, 910), 960) / 4) * 4 AS rounded FROM solutions""")
def _(v):
    c = scores.constraints({"f1": (None, 950.0), "f2": (5.0, 40.0)})
    return v.solutions.select("sol", scores.composite({"f1": 0.7, "f2": 0.3}, {"f2"}).alias("objective"), *[x.alias(n) for n, x in c.items()],
                              scores.to_resolution("f1", 910, 960, 4.0).alias("rounded"))
