"""Growth, stress, actuator, coupling and energy features."""

from pyspark.sql import functions as F

from ...functions import calendar as cal
from ...functions.climate import vpd as vpd_of
from ...operators import actuator as oa
from ...operators import coupling as oc
from ...operators import energy as oe
from ...operators import growth as og
from ...operators import stress as os_
from ..registry import query

# the climate view has one row per entity and day, so rows per key are bounded by the span;
# a few queries split it all the same, into half years, to keep that path checked
GRID, HALF = None, "182 days"
WIN = "PARTITION BY entity ORDER BY ts"


def fwd(n):
    return f"WINDOW w AS ({WIN} ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"


def full(expr, n, name):
    return f"CASE WHEN count(*) OVER w = {n} THEN {expr} END AS {name}"


# ------------------------------------------------------------------------- growth


@query("D-01", "growth_dli", views="readings_n", r="dli",
       sql="""SELECT entity, date_trunc('day', ts)::TIMESTAMP AS day, sum(coalesce(greatest(value, 0), 0) * coalesce((epoch_us(ts) - epoch_us(p)) / 1e6, 0) / 1e6) AS dli
       FROM (SELECT *, lag(ts) OVER (PARTITION BY entity ORDER BY ts) AS p FROM readings_n) GROUP BY ALL""")
def _(v):
    return og.dli(v.readings_n, "value", "entity", chunk=v.split("entity"))


@query("D-02", "growth_gdd_daily", views="readings_n", r="gdd_daily gdd_cumulative",
       sql="""WITH d AS (SELECT entity, date_trunc('day', ts)::TIMESTAMP AS day, min(value) AS lo, max(value) AS hi FROM readings_n GROUP BY ALL HAVING min(value) IS NOT NULL),
       g AS (SELECT entity, day, greatest((greatest(least(hi, 30), 10) + least(greatest(lo, 10), greatest(least(hi, 30), 10))) / 2 - 10, 0) AS gdd_daily FROM d)
       SELECT *, sum(gdd_daily) OVER (PARTITION BY entity ORDER BY day ROWS UNBOUNDED PRECEDING) AS gdd_cumulative FROM g""")
def _(v):
    return og.gdd_daily(v.readings_n, "value", "entity", 10.0, 30.0)


@query("D-03", "growth_gdd_variants", views="lines", r="hourly clamped daily",
       sql="""SELECT entity, hourly, clamped, daily FROM (SELECT entity, sum(greatest(temp - 10, 0)) / 24 AS hourly, sum(greatest(least(temp, 35) - 10, 0)) / 24 AS clamped FROM lines GROUP BY entity)
       JOIN (SELECT entity, sum(greatest(m - 10, 0)) AS daily FROM (SELECT entity, ts, avg(temp) AS m FROM lines GROUP BY ALL) GROUP BY entity) USING (entity)""")
def _(v):
    parts = [og.gdd(v.lines, "temp", "entity", m).withColumnRenamed("gdd", m) for m in ("hourly", "clamped", "daily")]
    return parts[0].join(parts[1], "entity").join(parts[2], "entity")


@query("D-04", "growth_dif", views="readings", r="dif",
       sql="""SELECT entity, date_trunc('day', ts)::TIMESTAMP AS day, avg(value) FILTER (hour(ts) BETWEEN 6 AND 17) - avg(value) FILTER (hour(ts) NOT BETWEEN 6 AND 17) AS dif FROM readings GROUP BY ALL""")
def _(v):
    return og.dif(v.readings, "value", cal.is_day_fixed("ts"), "entity")


@query("D-04", "growth_dif_lamps", views="readings", r="dif",
       sql="""SELECT signal, date_trunc('day', ts)::TIMESTAMP AS day, avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0) AS dif FROM readings GROUP BY ALL""")
def _(v):
    d = v.readings.withColumn("lamp", F.col("event_id") % 2)
    return og.dif(d, "value", cal.is_day_lamps(["lamp"]), "signal")


@query("D-05", "growth_photoperiod", views="wide", i="photoperiod_hours",
       sql="SELECT entity, date_trunc('day', hour)::TIMESTAMP AS day, count(*) FILTER (click > 20) AS photoperiod_hours FROM wide GROUP BY ALL")
def _(v):
    return og.photoperiod(v.wide, "entity", light="click", threshold=20.0, ts="hour")


GROW = "gdd dli photoperiod_hours light_sufficiency stress_degree_days temperature_optimality flowering_signal expected_growth"


@query("D-06", "growth_features", views="lines", r=GROW, digits=5,
       sql="""SELECT *, CASE WHEN photoperiod_hours < 10 THEN 1 WHEN photoperiod_hours > 14 THEN 0 ELSE 0.5 END AS flowering_signal, temperature_optimality * light_sufficiency * (1 - stress_degree_days / 10) AS expected_growth FROM (
       SELECT entity, sum(greatest(temp - 10, 0)) / 24 AS gdd, sum(l) * 3600 / 1e6 AS dli, sum((l > 0)::INT) AS photoperiod_hours,
       avg(greatest(0, least(1, l / 150))) AS light_sufficiency, (sum(greatest(temp - 30, 0)) + sum(greatest(5 - temp, 0))) / 24 AS stress_degree_days,
       (coalesce(avg(greatest(0, least(1, 1 - abs(temp - 22) / 10))) FILTER (l > 0), 0) + coalesce(avg(greatest(0, least(1, 1 - abs(temp - 18) / 10))) FILTER (NOT l > 0), 0)) / 2 AS temperature_optimality
       FROM (SELECT entity, temp, CASE WHEN line > 3 THEN light ELSE 0 END AS l FROM lines) GROUP BY entity)""")
def _(v):
    d = v.lines.withColumn("l", F.when(F.col("line") > 3, F.col("light")).otherwise(0.0)).withColumn("lit", (F.col("l") > 0).cast("int"))
    return og.growth_features(d, "temp", "l", "lit", "entity")


@query("D-06", "growth_traits", views="lines", r="gdd temperature_optimality stress_degree_days dli photoperiod_hours light_sufficiency flowering_signal",
       sql="""SELECT *, dli / 12 AS light_sufficiency, CASE WHEN photoperiod_hours <= 8 THEN 1 ELSE 0 END AS flowering_signal FROM (SELECT entity, ts, sum(greatest(temp - 10, 0)) / 24 AS gdd,
       avg(greatest(0, least(1, 1 - abs(temp - 22) / 10))) AS temperature_optimality, sum(CASE WHEN temp < 16 OR temp > 24 THEN abs(temp - 22) ELSE 0 END) / 24 AS stress_degree_days,
       sum(light) * 3600 / 1e6 / 24 AS dli, count(*) FILTER (light > 50) AS photoperiod_hours FROM lines GROUP BY ALL)""")
def _(v):
    return og.trait_growth(v.lines, "temp", "light", ["entity", "ts"])


@query("D-07,D-09,D-10", "growth_row_responses", views="lines", r="ptt hot efficiency heating cooling",
       sql="""SELECT orderkey, line, entity, ts, CASE WHEN temp > 10 AND temp < 40 THEN CASE WHEN temp <= 25 THEN (temp - 10) / 15 ELSE (40 - temp) / 15 END ELSE 0 END * least(1, light / 400) AS ptt,
       CASE WHEN temp > 35 THEN 1 ELSE 0 END AS hot, CASE WHEN temp BETWEEN 18 AND 26 THEN 1 WHEN temp >= 5 AND temp < 18 THEN (temp - 5) / 13 WHEN temp > 26 AND temp <= 40 THEN (40 - temp) / 14 ELSE 0 END AS efficiency,
       greatest(18 - temp, 0) AS heating, greatest(temp - 24, 0) AS cooling FROM lines""")
def _(v):
    deg = og.degree_hours("temp")
    return v.lines.select("orderkey", "line", "entity", "ts", og.photothermal("temp", "light", 10, 25, 40, 400).alias("ptt"),
                          og.heat_stress_hours("temp", 35.0).alias("hot"), og.thermal_efficiency("temp", 5, 18, 26, 40).alias("efficiency"),
                          deg["heating"].alias("heating"), deg["cooling"].alias("cooling"))


VPD = "greatest(0, 0.61078 * exp(17.27 * temp / (temp + 237.3)) * (1 - rh / 100))"


@query("D-08", "growth_cumulative", views="climate", r="cvpi ali", digits=5,
       sql=f"""SELECT entity, ts, sum(greatest({VPD} - 1.2, 0)) OVER w AS cvpi, sum(light * 3600 * 1e-6) OVER w AS ali FROM climate WINDOW w AS ({WIN} ROWS UNBOUNDED PRECEDING)""")
def _(v):
    d = v.climate.withColumn("vpd", vpd_of("temp", "rh"))
    return og.cumulative_indices(d, "entity", vpd="vpd", ppfd="light", chunk=HALF).select("entity", "ts", "cvpi", "ali")


@query("F-32", "light_scaled_par", views="readings", r="par",
       sql="""WITH x AS (SELECT event_id, signal, ts, date_trunc('day', ts) AS d, value * 4.57 AS cp, value AS ghi, CASE WHEN event_id % 3 > 0 THEN value * 0.8 END AS rad FROM readings),
       s AS (SELECT signal, d, least(greatest(0.3 / nullif(sum(cp) * 300 / 1e6, 0), 0.25), 4) AS scale FROM x GROUP BY ALL)
       SELECT event_id, cp * scale * coalesce(greatest(0, least(1, rad / nullif(ghi, 0))), 1) AS par FROM x JOIN s USING (signal, d)""")
def _(v):
    d = v.readings.withColumns({"cp": F.col("value") * 4.57, "ghi": F.col("value"), "obs": F.lit(0.3),
                                "rad": F.when(F.col("event_id") % 3 > 0, F.col("value") * 0.8)})
    return og.scaled_par(d, "cp", "signal", dli="obs", radiation="rad", clear_ghi="ghi").select("event_id", "par")


@query("D-28", "control_integral", views="readings", r="integral", digits=4,
       sql="""SELECT entity, sum(value * (epoch_us(ts) - coalesce(epoch_us(p), 2 * epoch_us(ts) - epoch_us(n))) / 1e6) / 3600 AS integral FROM (SELECT *, lag(ts) OVER q AS p, lead(ts) OVER q AS n FROM readings
       WINDOW q AS (PARTITION BY entity ORDER BY ts)) GROUP BY entity""")
def _(v):
    return og.total_integral(v.readings, "value", "entity", 1 / 3600, chunk=v.split("entity"))


@query("D-28", "control_setpoint", views="climate", r="mad in_range_pct",
       sql="SELECT entity, avg(abs(temp - 25)) AS mad, avg((temp BETWEEN 20 AND 30)::INT) * 100 AS in_range_pct FROM climate GROUP BY entity")
def _(v):
    return og.setpoint_scores(v.climate, "temp", F.lit(25.0), "entity", 20.0, 30.0)


@query("D-42", "growth_targets", views="climate", r="energy_target growth_target",
       sql=f"""SELECT entity, ts, greatest(0, greatest(0, (25 - temp) * 2) + light * 0.01 + greatest(0, co2 - 800) * 0.005) AS energy_target,
       greatest(0, least(1, light / 200) * greatest(0.3, 1 - abs(temp - 22) * 0.05) * greatest(0.5, 1 - abs(rh - 60) * 0.01) * CASE WHEN {VPD} BETWEEN 0.8 AND 1.2 THEN 1 ELSE greatest(0.6, 1 - abs({VPD} - 1) * 0.2) END) AS growth_target FROM climate""")
def _(v):
    d = v.climate.withColumns({"sp": F.lit(25.0), "vpd": vpd_of("temp", "rh")})
    names = {"temp": "temp", "setpoint": "sp", "light": "light", "co2": "co2", "rh": "rh", "vpd": "vpd"}
    return og.training_targets(d, names).select("entity", "ts", "energy_target", "growth_target")


# ------------------------------------------------------------------------- stress


@query("D-11", "stress_counts", views="climate", i="above_0 above_1",
       sql=f"SELECT entity, ts, {full('count(*) FILTER (temp > 20) OVER w', 14, 'above_0')}, {full('count(*) FILTER (temp > 35) OVER w', 14, 'above_1')} FROM climate {fwd(14)}")
def _(v):
    return os_.counts_above(v.climate, "temp", [20, 35], 14, "entity", chunk=GRID).select("entity", "ts", "above_0", "above_1")


@query("D-12,D-13", "stress_windows", views="climate", r="vpd_integral hot_hours cold_hours dim_hours bright_hours co2_low_integral", i="co2_low_count",
       sql=f"""SELECT entity, ts, {full(f'sum(greatest({VPD} - 1.2, 0)) OVER w', 10, 'vpd_integral')}, {full('count(*) FILTER (temp > 35) OVER w', 10, 'hot_hours')}, {full('count(*) FILTER (temp < 10) OVER w', 10, 'cold_hours')},
       {full('count(*) FILTER (light < 100 AND light > 0) OVER w', 10, 'dim_hours')}, {full('count(*) FILTER (light > 800) OVER w', 10, 'bright_hours')}, {full('count(*) FILTER (co2 < 800) OVER w', 10, 'co2_low_count')},
       {full('coalesce(sum(least((800 - co2) / 400, 1)) FILTER (co2 < 800) OVER w, 0)', 10, 'co2_low_integral')} FROM climate {fwd(10)}""")
def _(v):
    d = v.climate.withColumn("vpd", vpd_of("temp", "rh"))
    out = os_.stress_windows(d, 10, "entity", vpd="vpd", temp="temp", light="light", co2="co2", chunk=HALF)
    return out.select("entity", "ts", "vpd_integral", "hot_hours", "cold_hours", "dim_hours", "bright_hours", "co2_low_count", "co2_low_integral")


@query("D-14", "stress_combined", views="lines", r="stress",
       sql="SELECT orderkey, line, entity, ts, least(0.4 * temp / 50 + 0.3 * (rh - 40) / 50 + 0.2 * light / 1000 + 0.1 * (co2 - 400) / 800, 1) AS stress FROM lines")
def _(v):
    d = v.lines.withColumns({"a": F.col("temp") / 50, "b": (F.col("rh") - 40) / 50, "c": F.col("light") / 1000, "d": (F.col("co2") - 400) / 800})
    return d.select("orderkey", "line", "entity", "ts", os_.combined_stress({"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}).alias("stress"))


@query("D-15", "stress_recovery", views="readings", r="recovery_hours",
       sql="""SELECT event_id, i - coalesce(max(CASE WHEN value > 30 THEN i END) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS recovery_hours
       FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM readings)""")
def _(v):
    return os_.recovery_hours(v.readings, F.col("value") > 30, "entity", chunk=v.split("entity")).select("event_id", "recovery_hours")


@query("D-16", "stress_clusters", views="climate", r="cluster_hours", i="cluster_count",
       sql=f"""WITH f AS (SELECT *, temp > 30 AS s, coalesce(lag(temp > 30) OVER ({WIN}), FALSE) AS p FROM climate),
       c AS (SELECT entity, ts, count(*) OVER w AS n, count(*) FILTER (s) OVER w AS t, count(*) FILTER (s AND NOT p) OVER w + (s AND p)::INT AS k FROM f {fwd(20)})
       SELECT entity, ts, CASE WHEN n = 20 THEN k END AS cluster_count, CASE WHEN n = 20 THEN CASE WHEN k > 0 THEN t / k ELSE 0 END END AS cluster_hours FROM c""")
def _(v):
    return os_.clusters(v.climate, F.col("temp") > 30, 20, "entity", chunk=GRID).select("entity", "ts", "cluster_count", "cluster_hours")


@query("D-17", "stress_rapid", views="climate", r="humidity_stress_hours", i="rapid_changes",
       sql=f"""SELECT entity, count(*) FILTER (abs(temp - l) > 10) AS rapid_changes, count(*) FILTER (rh < 50 OR rh > 80) * 24 AS humidity_stress_hours FROM (SELECT *, lag(temp, 5) OVER ({WIN}) AS l FROM climate) GROUP BY entity""")
def _(v):
    return os_.rapid_changes(v.climate, "temp", "rh", "entity", 5, max_change=10.0, dry=50.0, step_h=24.0, chunk=GRID)


@query("D-17,D-26", "stress_share_hours", views="readings_n", r="stress_hours",
       sql="""SELECT entity, count(*) FILTER (value < 15 OR value > 30) / greatest(count(value), 1) * floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6) * count(value) / count(*) AS stress_hours FROM readings_n GROUP BY entity""")
def _(v):
    return os_.stress_share_hours(v.readings_n, "value", "entity", 15.0, 30.0)


# ---------------------------------------------------------------------- actuators


@query("D-18", "actuator_edges", views="readings_n", i="edges",
       sql="SELECT entity, count(*) FILTER (p <> o) AS edges FROM (SELECT entity, value > 20 AS o, lag(value > 20) OVER (PARTITION BY entity ORDER BY ts) AS p FROM readings_n WHERE value IS NOT NULL) GROUP BY entity")
def _(v):
    return oa.edge_count(v.readings_n, "value", 20.0, "entity", chunk=v.split("entity"))


@query("D-19", "actuator_duty", views="climate", r="duty_cycle", sql=f"SELECT entity, ts, {full('count(*) FILTER (temp > 25) OVER w / 12 * 100', 12, 'duty_cycle')} FROM climate {fwd(12)}")
def _(v):
    return oa.duty_cycle(v.climate, "temp", 25.0, 12, "entity", chunk=GRID).select("entity", "ts", "duty_cycle")


@query("D-20", "actuator_overshoot", views="lines", r="overshoot undershoot",
       sql="SELECT orderkey, line, entity, ts, CASE WHEN temp > light / 40 THEN temp - light / 40 ELSE 0 END AS overshoot, CASE WHEN temp > light / 40 THEN 0 ELSE light / 40 - temp END AS undershoot FROM lines")
def _(v):
    d = v.lines.withColumn("sp", F.col("light") / 40)
    return d.select("orderkey", "line", "entity", "ts", *[c.alias(n) for n, c in oa.overshoot("temp", "sp").items()])


@query("D-21", "actuator_settled", views="climate", r="settled",
       sql=f"SELECT entity, ts, {full('CASE WHEN greatest(max(temp) OVER w - 25, 25 - min(temp) OVER w) <= 25 * 60 / 100.0 THEN 1 ELSE 0 END', 4, 'settled')} FROM climate {fwd(4)}")
def _(v):
    return oa.settled(v.climate.withColumn("sp", F.lit(25.0)), "temp", "sp", 60.0, 4, "entity", chunk=GRID).select("entity", "ts", "settled")


@query("D-22", "actuator_effort", views="climate", r="effort",
       sql=f"""SELECT entity, ts, CASE WHEN n = 8 THEN e END AS effort FROM (SELECT entity, ts, count(*) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n, sum(s) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS e
       FROM (SELECT *, abs(lead(temp) OVER ({WIN}) - temp) AS s FROM climate))""")
def _(v):
    return oa.control_effort(v.climate, "temp", 8, "entity", chunk=HALF).select("entity", "ts", "effort")


@query("D-23", "actuator_sync", views="climate", r="sync", digits=4,
       sql=f"SELECT entity, ts, {full('CASE WHEN var_pop(temp) OVER w * var_pop(light) OVER w <= 1e-18 THEN 0 ELSE corr(temp, light) OVER w END', 15, 'sync')} FROM climate {fwd(15)}")
def _(v):
    return oa.synchronisation(v.climate, "temp", "light", 15, "entity", chunk=GRID).select("entity", "ts", "sync")


@query("D-24", "actuator_oscillations", views="climate", i="oscillations",
       sql=f"""SELECT entity, count(*) FILTER (abs(a) > 5 AND abs(b) > 5 AND sign(a) <> sign(b)) AS oscillations FROM (SELECT entity, lead(temp) OVER q - 2 * temp + lag(temp) OVER q AS b, temp - 2 * lag(temp) OVER q + lag(temp, 2) OVER q AS a FROM climate WINDOW q AS ({WIN})) GROUP BY entity""")
def _(v):
    return oa.oscillations(v.climate, "temp", 5.0, "entity", chunk=GRID)


@query("D-25", "actuator_daily", views="readings", r="value_avg absent_avg value_on_hours", i="value_changes",
       sql="""SELECT entity, date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS value_avg, NULL::DOUBLE AS absent_avg, count(*) FILTER (value <> p) AS value_changes, coalesce(sum(CASE WHEN value > 20 THEN (epoch_us(n) - epoch_us(ts)) / 3600e6 END), 0) AS value_on_hours
       FROM (SELECT *, lag(value) OVER q AS p, lead(ts) OVER q AS n FROM readings WINDOW q AS (PARTITION BY entity ORDER BY ts)) GROUP BY ALL""")
def _(v):
    return oa.daily_summary(v.readings, "entity", ["value", "absent"], ["value"], {"value": 20.0}, chunk=v.split("entity"))


@query("D-26", "actuator_movements", views="wide", i="movements",
       sql="""WITH l AS (SELECT entity, hour, s, x FROM (UNPIVOT wide ON click, error INTO NAME s VALUE x))
       SELECT entity, count(*) FILTER (abs(x - p) > 5) AS movements FROM (SELECT *, lag(x) OVER (PARTITION BY entity, s ORDER BY hour) AS p FROM l) GROUP BY entity""")
def _(v):
    return oa.movements(v.wide, ["click", "error"], "entity", "hour", chunk=None)


@query("D-26", "actuator_active_hours", views="wide", r="active_hours",
       sql="""SELECT entity, count(*) FILTER (click IS NOT NULL AND click > 5) / greatest(count(click), 1) * floor((epoch_us(max(hour)) - epoch_us(min(hour))) / 3600e6) * count(click) / count(*) * 0.5 AS active_hours FROM wide GROUP BY entity""")
def _(v):
    return oa.active_hours(v.wide, F.col("click") > 5, F.col("click").isNotNull(), "entity", "hour", 0.5)


@query("D-27", "control_ratios", views="climate", r="heating_needed mean_deviation max_deviation vpd_low vpd_high",
       sql="""SELECT entity, count(*) FILTER (temp < 25) / count(*) AS heating_needed, avg(abs(temp - 25)) AS mean_deviation, max(abs(temp - 25)) AS max_deviation, avg((rh / 40 / 10 * 8 < 0.4 * 4)::INT) AS vpd_low, avg((rh / 5 / 10 > 1.6)::INT) AS vpd_high FROM climate GROUP BY entity""".replace("avg((rh / 40 / 10 * 8 < 0.4 * 4)::INT)", "avg((rh / 5 / 10 < 0.4)::INT)"))
def _(v):
    d = v.climate.withColumns({"sp": F.lit(25.0), "vpd_hpa": F.col("rh") / 5})
    return oa.control_ratios(d, "entity", "temp", "sp", "vpd_hpa")


@query("D-27", "control_lamp_yield", views="climate", r="dli_per_hour",
       sql="""SELECT entity, sum(light) / nullif((avg((temp > 0.5)::INT) + avg((wind - 2 > 0.5)::INT)) * (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6, 0) AS dli_per_hour FROM climate GROUP BY entity""")
def _(v):
    return oa.lamp_yield(v.climate.withColumn("w2", F.col("wind") - 2), "entity", "light", ["temp", "w2"])


# ----------------------------------------------------------------------- coupling


@query("D-29", "coupling_weather", views="climate", r="temp_diff_mean temp_diff_std solar_efficiency solar_gain thermal_mass ventilation",
       sql="""SELECT entity, m AS temp_diff_mean, s AS temp_diff_std, e AS solar_efficiency, g AS solar_gain, s / (o + 1e-8) AS thermal_mass, 1 / (1 + s) AS ventilation FROM (SELECT entity, avg(temp - out_temp) AS m, stddev(temp - out_temp) AS s,
       avg((temp - out_temp) / light) FILTER (light > 0) AS e, sum(greatest(temp - out_temp, 0)) / sum(light) AS g, stddev(out_temp) AS o FROM climate GROUP BY entity)""")
def _(v):
    return oc.weather_coupling(v.climate, "temp", "out_temp", "light", "entity")


LAGS = range(4)


@query("D-29", "coupling_best_lag", views="climate", r="corr", i="lag", digits=5,
       sql="WITH l AS (SELECT entity, out_temp, " + ", ".join(f"lead(temp, {k}) OVER ({WIN}) AS y{k}" for k in LAGS) + " FROM climate), r AS (" + " UNION ALL ".join(
           f"SELECT entity, {k} AS lag, corr(y{k}, out_temp) AS corr FROM l GROUP BY entity" for k in LAGS) + ") SELECT entity, arg_max(lag, (corr, -lag)) AS lag, max(corr) AS corr FROM r GROUP BY entity")
def _(v):
    return oc.best_lag(v.climate, "out_temp", "temp", 3, "entity", chunk=GRID)


@query("D-34", "coupling_rolling_lag", views="climate", r="corr", digits=4,
       sql=f"""WITH l AS (SELECT entity, ts, out_temp, {', '.join(f'lead(temp, {k}) OVER ({WIN}) AS y{k}' for k in LAGS)} FROM climate),
       r AS (SELECT entity, ts, count(y3) OVER w AS n, {', '.join(f'corr(y{k}, out_temp) OVER w AS r{k}' for k in LAGS)} FROM l {fwd(20)})
       SELECT entity, ts, CASE WHEN n = 20 THEN greatest(r0, r1, r2, r3) END AS corr FROM r""")
def _(v):
    return oc.rolling_lag(v.climate.select("entity", "ts", "out_temp", "temp"), "out_temp", "temp", 3, 20, "entity", chunk=GRID).select("entity", "ts", "corr")


@query("D-30", "coupling_slope", views="climate", r="slope", digits=3,
       sql=f"""SELECT entity, ts, {full('CASE WHEN count(x) OVER w > 10 THEN regr_slope(y, x) OVER w ELSE 0 END', 24, 'slope')} FROM (SELECT entity, ts, CASE WHEN abs(temp - out_temp) > 5 THEN temp - out_temp END AS x, CASE WHEN abs(temp - out_temp) > 5 THEN power END AS y FROM climate) {fwd(24)}""")
def _(v):
    return oc.thermal_slope(v.climate, "temp", "out_temp", "power", 24, "entity", min_diff=5.0, chunk=GRID).select("entity", "ts", "slope")


@query("D-31", "coupling_radiation_gain", views="climate", r="radiation_gain shgc",
       sql=f"""SELECT entity, ts, CASE WHEN nx IS NOT NULL THEN CASE WHEN light > 50 AND nx > temp THEN least(500 * (nx - temp) / (light * 20 * 3.6), 1) ELSE 0 END END AS radiation_gain,
       CASE WHEN light > 100 AND wind > 0 THEN least(500 * wind / (light * 20 * 3.6), 0.87) ELSE 0.4 END * (1 - 0.8 * rh / 100) AS shgc FROM (SELECT *, lead(temp) OVER ({WIN}) AS nx FROM climate)""")
def _(v):
    d = oc.radiation_gain(v.climate, "light", "temp", 20.0, 500.0, "entity", chunk=GRID)
    return d.select("entity", "ts", "radiation_gain", oc.shgc("light", "wind", "rh", 500.0, 20.0).alias("shgc"))


@query("D-32", "coupling_air", views="climate", r="influx infiltration",
       sql="""SELECT entity, ts, (out_temp - temp) * (rh / 100 * 12 * (0.5 + 0.5 * sqrt(wind)) / 900) AS influx, (1 - rh / 100) * (sqrt(4 * abs(temp - out_temp) / ((temp + out_temp) / 2 + 273.15)) * 0.15 + 0.05 * sqrt(wind) + 0.02 * sqrt(abs(n::DOUBLE))) AS infiltration FROM climate""")
def _(v):
    return v.climate.select("entity", "ts", oc.humidity_influx("temp", "out_temp", "rh", "wind", 12.0, 900.0).alias("influx"),
                            oc.infiltration("temp", "out_temp", "wind", "n", "rh", 4.0).alias("infiltration"))


@query("D-33", "coupling_vent", views="climate", r="efficacy",
       sql=f"""WITH a AS (SELECT *, lag(co2) OVER ({WIN}) AS p FROM climate), b AS (SELECT *, CASE WHEN rh / 100 > 0.1 AND rh / 100 * (p - 420) * 0.8 > 0 THEN rh / 100 * (p - 420) * 0.8 END AS t,
       CASE WHEN rh / 100 > 0.1 AND rh / 100 * (p - 420) * 0.8 > 0 THEN greatest(p + wind - co2, 0) END AS d FROM a),
       c AS (SELECT entity, ts, count(*) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n, sum(t) OVER s AS t, sum(d) OVER s AS d FROM b WINDOW s AS ({WIN} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
       SELECT entity, ts, CASE WHEN n = 6 THEN CASE WHEN t > 0 THEN least(d / t, 1) ELSE 0 END END AS efficacy FROM c""")
def _(v):
    d = v.climate.withColumn("co2_out", F.lit(420.0))
    return oc.vent_efficacy(d, "co2", "co2_out", "wind", "rh", 6, "entity", chunk=HALF).select("entity", "ts", "efficacy")


@query("D-35", "coupling_u_value", views="climate", r="u_value",
       sql=f"""SELECT entity, ts, {full('CASE WHEN count(s) OVER w > 5 AND sum(s) OVER w > 0 THEN sum(l) OVER w / sum(s) OVER w ELSE 3 END', 12, 'u_value')} FROM (SELECT entity, ts, CASE WHEN light * 0.1 * 0.7 < 50 AND abs(temp - out_temp) > 2 THEN power * 1000 END AS l,
       CASE WHEN light * 0.1 * 0.7 < 50 AND abs(temp - out_temp) > 2 THEN (temp - out_temp) * 200 END AS s FROM climate) {fwd(12)}""")
def _(v):
    return oc.u_value(v.climate, "temp", "out_temp", "power", "light", 200.0, 0.1, 12, "entity", chunk=GRID).select("entity", "ts", "u_value")


@query("D-36", "coupling_simple", views="climate", r="light_temp co2_temp thermal_inertia", digits=5,
       sql=f"""SELECT entity, coalesce(corr(light, temp), 0) AS light_temp, covar_pop(co2, temp) AS co2_temp, 1 / (1 + coalesce(max(abs(temp - l) / 60), 0)) AS thermal_inertia FROM (SELECT *, lag(temp, 60) OVER ({WIN}) AS l FROM climate) GROUP BY entity""")
def _(v):
    return oc.simple_coupling(v.climate, "light", "temp", "co2", "entity", chunk=GRID)


# ------------------------------------------------------------------------- energy

SPOT = "spot AS (SELECT w.entity, w.hour, w.view AS power, p.price FROM wide w JOIN price p USING (hour) WHERE w.view IS NOT NULL)"


def spot(v):
    """Hours with power and a price; hours without a price cost nothing that is known, and take no part."""
    return v.wide.where("view IS NOT NULL").select("entity", "hour", F.col("view").alias("power")).join(v.price, "hour")


for _rule, _test in (("p75", "price > quantile_cont(price, 0.75) OVER (PARTITION BY entity)"), ("mean", "price > avg(price) OVER (PARTITION BY entity)"), ("hours", "hour(hour) >= 7 AND hour(hour) < 23")):
    @query("D-37", f"energy_features_{_rule}", views="wide price", r="cost_weighted peak_ratio_sum peak_ratio_mean efficiency cost_per_degree_hour", digits=5,
           sql=f"""WITH {SPOT}, m AS (SELECT *, {_test} AS pk FROM spot) SELECT entity, sum(power * price) AS cost_weighted, CASE WHEN sum(power) FILTER (NOT pk) > 0 THEN coalesce(sum(power) FILTER (pk), 0) / sum(power) FILTER (NOT pk) ELSE 999 END AS peak_ratio_sum,
           coalesce(avg(power) FILTER (pk) / (avg(power) FILTER (NOT pk) + 1e-8), 1) AS peak_ratio_mean, coalesce(sum(power) / nullif(sum(power * price), 0), 0) AS efficiency, sum(power * price) / 480 AS cost_per_degree_hour FROM m GROUP BY entity""")
    def _(v, rule=_rule):
        return oe.energy_features(oe.mark_peaks(spot(v), "price", "entity", rule, chunk=None), "power", "price", "is_peak", "entity")


@query("D-37", "energy_load_shift", views="wide price", r="shift_saving",
       sql=f"""WITH {SPOT}, q AS (SELECT entity, quantile_cont(price, 0.25) AS q FROM spot GROUP BY entity) SELECT entity, (avg(price) - avg(price) FILTER (price <= q)) * avg(power) AS shift_saving FROM spot JOIN q USING (entity) GROUP BY entity""")
def _(v):
    return oe.load_shift(spot(v), "power", "price", "entity", chunk=None)


@query("D-37", "energy_until_cheap", views="price", r="hours_until_cheap",
       sql="""SELECT hour, CASE WHEN price <= q THEN 0 ELSE (nx - epoch_us(hour)) / 3600e6 END AS hours_until_cheap FROM (SELECT *, min(CASE WHEN price < q THEN epoch_us(hour) END) OVER (ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx
       FROM price, (SELECT quantile_cont(price, 0.25) AS q FROM price))""")
def _(v):
    return oe.hours_until_cheap(v.price, "price", (), chunk=None).select("hour", "hours_until_cheap")


@query("D-38,D-39,D-40", "energy_windows", views="wide price", r="weighted_cost cost_efficiency peak_ratio tou_score roi", digits=4,
       sql=f"""WITH {SPOT}, a AS (SELECT entity, hour, count(*) OVER w AS n, sum(power * price) OVER w AS c, sum(power) OVER w AS t, min(price) OVER w AS lo, max(price) OVER w AS hi, count(*) OVER w * 10.0 AS made, count(*) OVER w * 1.0 AS oth,
       coalesce(sum(power) FILTER (hour(hour) >= 7 AND hour(hour) < 23) OVER w, 0) AS pk, coalesce(sum(power) FILTER (NOT (hour(hour) >= 7 AND hour(hour) < 23)) OVER w, 0) AS op FROM spot WINDOW w AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
       SELECT entity, hour, CASE WHEN n = 8 THEN c END AS weighted_cost, CASE WHEN n = 8 THEN CASE WHEN c > 0 THEN made / c ELSE 0 END END AS cost_efficiency, CASE WHEN n = 8 THEN CASE WHEN op > 0 THEN pk / op ELSE pk END END AS peak_ratio,
       CASE WHEN n = 8 THEN CASE WHEN t * hi > t * lo THEN 1 - (c - t * lo) / (t * hi - t * lo) ELSE 1 END END AS tou_score, CASE WHEN n = 8 THEN CASE WHEN c + oth > 0 THEN (made - c - oth) / (c + oth) ELSE 0 END END AS roi FROM a""")
def _(v):
    d = spot(v).withColumns({"made": F.lit(10.0), "other": F.lit(1.0)})
    out = oe.cost_windows(d, 8, "entity", energy="power", price="price", output="made", other="other", hour=F.hour("hour"), chunk=None)
    return out.select("entity", "hour", "weighted_cost", "cost_efficiency", "peak_ratio", "tou_score", "roi")


@query("D-38,D-40", "energy_rows", views="climate", r="dr carbon forecast",
       sql="""SELECT entity, ts, CASE WHEN price > 900 THEN (price - 900) * (rh / 100) * power ELSE 0 END AS dr, power * co2 AS carbon, CASE WHEN power > temp * 1.5 THEN (power - temp * 1.5) * (price + 0.2) ELSE (temp * 1.5 - power) * price * 0.5 END AS forecast FROM climate""")
def _(v):
    d = v.climate.withColumns({"flex": F.col("rh") / 100, "fc": F.col("temp") * 1.5})
    return d.select("entity", "ts", oe.demand_response("price", "flex", "power", 900.0).alias("dr"), oe.carbon("power", "co2").alias("carbon"),
                    oe.forecast_cost("fc", "power", "price", 0.2).alias("forecast"))


@query("D-41", "energy_peak_lamps", views="wide price", r="peak_activity",
       sql="""WITH m AS (SELECT w.*, p.price > (SELECT quantile_cont(price, 0.75) FROM (SELECT price FROM wide JOIN price USING (hour))) AS pk FROM wide w JOIN price p USING (hour))
       SELECT entity, (coalesce(avg((click > 0.5)::INT) FILTER (pk), 0) + coalesce(avg((error > 0.5)::INT) FILTER (pk), 0)) / 2 AS peak_activity FROM m GROUP BY entity""")
def _(v):
    d = oe.mark_peaks(v.wide.join(v.price, "hour"), "price", (), "p75", chunk=v.split(of="wide"))
    return oe.peak_lamp_activity(d, ["click", "error"], "is_peak", "entity")


@query("D-37", "energy_price_of_area", views="readings", r="price",
       sql="SELECT hour, avg(value) AS price FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, value FROM readings WHERE signal = 'view') GROUP BY hour")
def _(v):
    d = v.readings.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("signal").alias("area"), F.col("value").alias("price"))
    return oe.price_of_area(d, "view")


@query("P-14", "energy_economic_impact", views="solutions climate", r="annual_energy_cost annual_production_value energy_cost_savings production_value_increase net_benefit roi_percent", digits=3,
       sql="""WITH h AS (SELECT avg(power) AS he, avg(temp) AS hg FROM climate), s AS (SELECT algorithm, avg(f1) AS e, avg(f2) AS g FROM solutions GROUP BY algorithm)
       SELECT algorithm, e * 365 * 0.25 AS annual_energy_cost, g * 365 * 2.5 AS annual_production_value, (he - e) * 365 * 0.25 AS energy_cost_savings, (g - hg) * 365 * 2.5 AS production_value_increase,
       (he - e) * 365 * 0.25 + (g - hg) * 365 * 2.5 AS net_benefit, ((he - e) * 365 * 0.25 + (g - hg) * 365 * 2.5) * 100 / (he * 365 * 0.25) AS roi_percent FROM s, h""")
def _(v):
    hist = v.climate.select(F.col("power").alias("e"), F.col("temp").alias("g"))
    return oe.economic_impact(v.solutions.withColumns({"e": F.col("f1"), "g": F.col("f2")}), hist, "e", "g", "algorithm")
