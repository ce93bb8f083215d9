"""Dependence, complexity, spectra, series calculators, changepoints."""

from pyspark.sql import functions as F

from ...frames import epoch, floor_div, from_epoch, last_valid, next_valid, running_count, scan
from ...functions import calendar as cal
from ...operators import agg as oa
from ...operators import changepoint as ch
from ...operators import complexity as cx
from ...operators import features as ft
from ...operators import segment as sg
from ...operators import spectral as spx
from ..registry import query
from .grid import DENSE

HALF = "182 days"
WIN = "PARTITION BY entity ORDER BY ts"


def _cov(y):
    return f"covar_pop(CASE WHEN {y} IS NOT NULL THEN x END, {y}) + (avg(x) FILTER ({y} IS NOT NULL) - avg(x)) * (avg({y}) - avg(x))"


@query("X-01,X-02", "complexity_acf", views="climate", r="acf1 acf2 acf3 pacf2 pacf3", i="zero_lag", digits=5,
       sql=f"""WITH l AS (SELECT entity, temp AS x, lag(temp, 1) OVER ({WIN}) AS a, lag(temp, 2) OVER ({WIN}) AS b, lag(temp, 3) OVER ({WIN}) AS c FROM climate),
       r AS (SELECT entity, ({_cov('a')}) / var_pop(x) AS r1, ({_cov('b')}) / var_pop(x) AS r2, ({_cov('c')}) / var_pop(x) AS r3 FROM l GROUP BY entity),
       p AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM r)
       SELECT entity, r1 AS acf1, r2 AS acf2, r3 AS acf3, p2 AS pacf2, (r3 - (r1 - p2 * r1) * r2 - p2 * r1) / (1 - (r1 - p2 * r1) * r1 - p2 * r2) AS pacf3,
       CASE WHEN r1 <= 0 THEN 1 WHEN r2 <= 0 THEN 2 WHEN r3 <= 0 THEN 3 END AS zero_lag FROM p""")
def _(v):
    d = cx.pacf(cx.acf(v.climate, "temp", 3, "entity", chunk=None))
    return d.select("entity", *[F.col("acf")[k].alias(f"acf{k}") for k in (1, 2, 3)], *[F.col("pacf")[k].alias(f"pacf{k}") for k in (2, 3)], "zero_lag")


@query("X-03", "complexity_xcorr", views="climate", r="r best_r", i="lag", digits=5,
       sql=f"""WITH l AS (SELECT entity, temp AS x, light AS y0, lag(light) OVER ({WIN}) AS ym, lead(light) OVER ({WIN}) AS yp FROM climate),
       s AS (SELECT entity, avg(x) AS mx, avg(y0) AS my, stddev_pop(x) * stddev_pop(y0) AS s FROM l GROUP BY entity),
       r AS (SELECT entity, unnest([-1, 0, 1]) AS lag, unnest([m, z, p]) AS r FROM (SELECT entity, avg((x - mx) * (ym - my)) / any_value(s) AS m, avg((x - mx) * (y0 - my)) / any_value(s) AS z, avg((x - mx) * (yp - my)) / any_value(s) AS p FROM l JOIN s USING (entity) GROUP BY entity))
       SELECT entity, lag, r, first_value(r) OVER (PARTITION BY entity ORDER BY abs(r) DESC, lag) AS best_r FROM r""")
def _(v):
    d = cx.cross_correlation(v.climate, "temp", "light", 1, "entity", chunk=HALF)
    return d.select("entity", F.inline("xcorr"), "best_r")


@query("X-04", "complexity_mutual_info", views="climate", r="mutual_info",
       sql=f"""WITH l AS (SELECT * FROM (SELECT entity, temp AS x, lead(light, 2) OVER ({WIN}) AS y FROM climate) WHERE y IS NOT NULL),
       e AS (SELECT entity, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM l GROUP BY entity),
       j AS (SELECT entity, floor((x - x0) / (x1 - x0 + 1e-10) * 7) AS i, floor((y - y0) / (y1 - y0 + 1e-10) * 7) AS j, count(*) / any_value(n) AS p FROM l JOIN e USING (entity) GROUP BY 1, 2, 3),
       a AS (SELECT *, sum(p) OVER (PARTITION BY entity, i) AS px, sum(p) OVER (PARTITION BY entity, j) AS py FROM j)
       SELECT entity, sum(p * log2(p / (px * py))) AS mutual_info FROM a GROUP BY entity""")
def _(v):
    return cx.delayed_mutual_info(v.climate, "temp", "light", 2, 8, "entity", chunk=None)


@query("X-05", "complexity_shannon", views="readings", r="entropy",
       sql="""WITH e AS (SELECT entity, min(value) AS lo, max(value) AS hi, count(*) AS n FROM readings GROUP BY entity), b AS (SELECT entity, least(floor((value - lo) / (hi - lo) * 10), 9) AS b, count(*) / any_value(n) AS p FROM readings JOIN e USING (entity) GROUP BY 1, 2)
       SELECT entity, -sum(p * log2(p)) AS entropy FROM b GROUP BY entity""")
def _(v):
    return oa.histogram_entropy(v.readings, "value", "entity", 10)


# days of the hourly series of all readings: 24 values per block, hours without a reading filled from before or else from after
DAYS = """h0 AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS v FROM readings GROUP BY 1),
g AS (SELECT unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts FROM h0),
h AS (SELECT ts, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g LEFT JOIN h0 USING (ts)),
d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, list(v ORDER BY ts) AS x FROM h GROUP BY 1 HAVING count(*) = 24),
s AS (SELECT day, x, sqrt(list_var_pop(x)) AS sd FROM d),
p AS (SELECT day, sd, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM s)"""


def days(v):
    h = v.readings.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("v"))
    ends = h.agg(F.min(epoch(cal.trunc("day", "ts"))).alias("a"), F.max(epoch(cal.trunc("day", "ts"))).alias("b"))
    points = ends.select(F.explode(F.expr("sequence(a, b + 82800000000, 3600000000)")).alias("us")).select(from_epoch(F.col("us")).alias("ts"))
    grid = scan(points.join(h, "ts", "left"), (), "ts", {"_p": last_valid("v"), "_n": next_valid("v")}, chunk=None)
    return cx.blocks(grid.select("ts", F.coalesce("_p", "_n").alias("v")), "v", (), cal.trunc("day", "ts").alias("day"), size=24)


def _pairs(m, own):
    tests = " AND ".join(f"abs(list_extract(x, i + {s}) - list_extract(x, j + {s})) <= 0.2 * sd" for s in range(m))
    return tests + ("" if own else " AND i <> j")


@query("X-06", "complexity_sample_entropy", views="readings", r="sample_entropy",
       sql=f"""WITH {DAYS}, q AS (SELECT day, x, sd, i, j FROM s, generate_series(1, 22) a(i), generate_series(1, 22) b(j)),
       c AS (SELECT day, count(*) FILTER ({_pairs(2, False)}) AS b, count(*) FILTER ({_pairs(3, False)}) AS a FROM q GROUP BY day)
       SELECT day, CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) ELSE 0 END AS sample_entropy FROM c""")
def _(v):
    return cx.sample_entropy(days(v)).select("day", "sample_entropy")


def _phi(m):
    n = 24 - (m - 1)
    return f"(SELECT day, avg(ln(c / {n})) AS phi{m} FROM (SELECT day, i, count(*) FILTER ({_pairs(m, True)}) AS c FROM s, generate_series(1, {n}) a(i), generate_series(1, {n}) b(j) GROUP BY ALL) GROUP BY day)"


@query("X-07", "complexity_approximate_entropy", views="readings", r="approximate_entropy",
       sql=f"WITH {DAYS} SELECT day, phi2 - phi3 AS approximate_entropy FROM {_phi(2)} JOIN {_phi(3)} USING (day)")
def _(v):
    return cx.approximate_entropy(days(v)).select("day", "approximate_entropy")


@query("X-08", "complexity_permutation_entropy", views="climate", r="permutation_entropy",
       sql=f"""WITH l AS (SELECT entity, temp AS a, lead(temp, 1) OVER ({WIN}) AS b, lead(temp, 2) OVER ({WIN}) AS c FROM climate),
       k AS (SELECT entity, ((b < a)::INT + (c < a)::INT, (a < b)::INT + (c < b)::INT, (a < c)::INT + (b < c)::INT) AS pat, count(*) AS n FROM l WHERE c IS NOT NULL GROUP BY ALL),
       q AS (SELECT entity, n / sum(n) OVER (PARTITION BY entity) AS p FROM k) SELECT entity, -sum(p * log2(p)) / log2(6) AS permutation_entropy FROM q GROUP BY entity""")
def _(v):
    return cx.permutation_entropy(v.climate, "temp", 3, "entity", chunk=None)


@query("X-09", "complexity_higuchi", views="climate", r="fractal_dimension", digits=5,
       sql="WITH o AS (SELECT entity, ts, temp, row_number() OVER (" + WIN + ") - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM climate), l AS (" + " UNION ALL ".join(
           f"SELECT entity, n, i, {k} AS k, abs(lead(temp, {k}) OVER ({WIN}) - temp) AS d FROM o" for k in range(1, 6)) + """),
       c AS (SELECT entity, k, i % k AS m, sum(d) * (any_value(n) - 1) / (count(*) * k * k) AS l FROM l WHERE d IS NOT NULL GROUP BY entity, k, i % k), g AS (SELECT entity, k, avg(l) AS l FROM c GROUP BY ALL)
       SELECT entity, regr_slope(ln(l), ln(1 / k)) AS fractal_dimension FROM g WHERE l > 0 GROUP BY entity""")
def _(v):
    return cx.higuchi(v.climate, "temp", 5, "entity", chunk=None)


PARSED = """d AS (SELECT day, array_to_string(list_transform(x, lambda v: CASE WHEN v > 15 THEN '1' ELSE '0' END), '') AS bits FROM s),
       r AS (SELECT day, bits, 0 AS i, 0 AS n FROM d UNION ALL SELECT day, bits, i + coalesce(list_min(list_filter(range(1, length(bits) - i + 1), lambda k: NOT contains(substr(bits, 1, i + k - 1), substr(bits, i + 1, k)))), length(bits) - i), n + 1
             FROM r WHERE i < length(bits))"""


# the next phrase is the shortest piece that has not occurred from an earlier start
@query("X-10", "complexity_lempel_ziv", views="readings", i="lz_complexity", sql=f"WITH RECURSIVE {DAYS.replace('d AS (', 'e AS (', 1).replace('FROM d)', 'FROM e)', 1)}, {PARSED} SELECT day, max(n) AS lz_complexity FROM r GROUP BY day")
def _(v):
    return ch.lz_complexity(days(v), F.lit(15.0)).select("day", "lz_complexity")


SPEC = f"""{DAYS}, m AS (SELECT day, b, sqrt(pow(sum(v * cos(2 * pi() * b * i / 24)), 2) + pow(sum(v * sin(2 * pi() * b * i / 24)), 2)) AS mag FROM p, generate_series(0, 11) g(b) GROUP BY ALL)"""


@query("X-11", "spectral_features", views="readings", r="band_0 band_1 centroid peak_frequency peak_magnitude spectral_entropy rolloff",
       sql=f"""WITH {SPEC}, t AS (SELECT *, sum(mag) OVER (PARTITION BY day) AS tot, sum(mag) OVER (PARTITION BY day ORDER BY b) AS run FROM m)
       SELECT day, sum(mag) FILTER (b < 3) AS band_0, sum(mag) FILTER (b >= 3 AND b < 12) AS band_1, sum(mag * b / 24) / any_value(tot) AS centroid, arg_max(b, (mag, -b)) FILTER (b >= 1) / 24 AS peak_frequency,
       max(mag) FILTER (b >= 1) AS peak_magnitude, -sum(mag / tot * log2(mag / tot)) AS spectral_entropy, min(b) FILTER (run >= tot * 0.85) / 24 AS rolloff FROM t GROUP BY day""")
def _(v):
    f = spx.spectral_features(spx.magnitudes(days(v), 24), 24, 1.0, [(0, 3), (3, 12)])
    return f.select("day", "band_0", "band_1", "centroid", "peak_frequency", "peak_magnitude", "spectral_entropy", "rolloff")


@query("X-11", "spectral_flux", views="readings", r="flux",
       sql=f"""WITH {SPEC}, l AS (SELECT day, b, mag - lag(mag) OVER (PARTITION BY b ORDER BY day) AS d FROM m) SELECT day, CASE WHEN count(d) > 0 THEN sqrt(sum(pow(greatest(d, 0), 2))) END AS flux FROM l GROUP BY day""")
def _(v):
    return spx.spectral_flux(spx.magnitudes(days(v), 24), (), "day").select("day", "flux")


H = spx.LOW


def _dwt_sql(src, dst, n):
    """SQL for one periodic decomposition step from (day, i, v) rows."""
    at = lambda s: f"max(v) FILTER (i = (2 * t + {s}) % {n})"
    lo = " + ".join(f"({H[s]!r}) * {at(s)}" for s in range(4))
    hi = f"({H[3]!r}) * {at(0)} - ({H[2]!r}) * {at(1)} + ({H[1]!r}) * {at(2)} - ({H[0]!r}) * {at(3)}"
    return f"{dst} AS (SELECT day, t AS i, {lo} AS v, {hi} AS d FROM {src}, generate_series(0, {n // 2 - 1}) g(t) GROUP BY day, t)"


@query("X-12", "wavelet_features", views="readings", r="energy_d1 energy_d2 energy_a wavelet_entropy",
       sql=f"""WITH {DAYS}, {_dwt_sql('p', 'l1', 24)}, {_dwt_sql('l1', 'l2', 12)},
       e AS (SELECT day, d1 AS energy_d1, d2 AS energy_d2, a AS energy_a, d1 + d2 + a AS t FROM (SELECT day, sum(d * d) AS d1 FROM l1 GROUP BY day) JOIN (SELECT day, sum(d * d) AS d2, sum(v * v) AS a FROM l2 GROUP BY day) USING (day))
       SELECT * EXCLUDE (t), -(energy_d1 / t * log2(energy_d1 / t) + energy_d2 / t * log2(energy_d2 / t) + energy_a / t * log2(energy_a / t)) AS wavelet_entropy FROM e""")
def _(v):
    return spx.wavelet_features(spx.dwt(days(v), 24, 2), 2).select("day", "energy_d1", "energy_d2", "energy_a", "wavelet_entropy")


@query("X-12", "wavelet_packet", views="readings", r="packet_norms", i="pos",
       sql=f"""WITH {DAYS}, {_dwt_sql('p', 'l1', 24)}, b1 AS (SELECT day, i, d AS v FROM l1), {_dwt_sql('l1', 'll', 12)}, {_dwt_sql('b1', 'lh', 12)}
       SELECT day, 0 AS pos, sqrt(sum(v * v)) AS packet_norms FROM ll GROUP BY day UNION ALL SELECT day, 1, sqrt(sum(d * d)) FROM ll GROUP BY day
       UNION ALL SELECT day, 2, sqrt(sum(v * v)) FROM lh GROUP BY day UNION ALL SELECT day, 3, sqrt(sum(d * d)) FROM lh GROUP BY day""")
def _(v):
    return spx.explode_block(spx.packet_energy(days(v), 24, 2), "day", "packet_norms")


@query("X-13", "wavelet_round_trip", views="readings", r="denoised", i="pos",
       sql=f"WITH {DAYS} SELECT day, i AS pos, v AS denoised FROM p")
def _(v):
    return spx.explode_block(spx.denoise(days(v), 24, 2, 0.0), "day", "denoised")


def _idwt_sql(approx, detail, dst, half):
    """SQL for one synthesis step from approximations (day, i, v) and details (day, i, d)."""
    part = lambda s: f"({spx.LOW[s]!r}) * a.v + ({spx.HIGH[s]!r}) * d.d + ({spx.LOW[s + 2]!r}) * b.v + ({spx.HIGH[s + 2]!r}) * e.d"
    return (f"{dst} AS (SELECT a.day, 2 * a.i + o AS i, CASE o WHEN 0 THEN {part(0)} ELSE {part(1)} END AS v FROM {approx} a JOIN {approx} b ON b.day = a.day AND b.i = (a.i + {half - 1}) % {half} "
            f"JOIN {detail} d ON d.day = a.day AND d.i = a.i JOIN {detail} e ON e.day = a.day AND e.i = b.i, (SELECT unnest([0, 1]) AS o))")


_SOFT = "(SELECT day, i, sign(d) * greatest(abs(d) - 1.0, 0) AS d FROM {})"


@query("X-13", "wavelet_denoise", views="readings", r="denoised", i="pos",
       sql=f"""WITH {DAYS}, {_dwt_sql('p', 'l1', 24)}, {_dwt_sql('l1', 'l2', 12)}, s1 AS {_SOFT.format('l1')}, s2 AS {_SOFT.format('l2')},
       {_idwt_sql('l2', 's2', 'r1', 6)}, {_idwt_sql('r1', 's1', 'r0', 12)} SELECT day, i AS pos, v AS denoised FROM r0""")
def _(v):
    return spx.explode_block(spx.denoise(days(v), 24, 2, 1.0), "day", "denoised")


@query("X-14", "wavelet_cwt", views="climate", r="cwt_0", digits=4,
       sql=f"""WITH o AS (SELECT entity, ts, temp, row_number() OVER ({WIN}) AS i FROM climate)
       SELECT a.entity, a.ts, sqrt(pow(sum(b.temp * exp(-0.5 * pow((a.i - b.i) / 2.0, 2)) / sqrt(2) * cos(6 * (a.i - b.i) / 2.0)), 2) + pow(sum(b.temp * exp(-0.5 * pow((a.i - b.i) / 2.0, 2)) / sqrt(2) * sin(6 * (a.i - b.i) / 2.0)), 2)) AS cwt_0
       FROM o a JOIN o b ON a.entity = b.entity GROUP BY a.entity, a.ts""")
def _(v):
    return spx.cwt(v.climate, "temp", [2.0], "entity", chunk=HALF).select("entity", "ts", "cwt_0")


COHERENCE_SCALES = [2.0, 4.0]


def _coherence_sql(half: int) -> str:
    """Both transforms by all pairs of rows within nine of the largest scale, then sums over neighbouring rows."""
    part = lambda v, fn, s: f"sum(b.{v} * exp(-0.5 * pow((a.i - b.i) / {s}, 2)) / sqrt({s}) * {fn}(6 * (a.i - b.i) / {s}))"
    made = ", ".join(f"{part(v, fn, s)} AS {fn}_{v}_{i}" for i, s in enumerate(COHERENCE_SCALES) for v in ("temp", "light") for fn in ("cos", "sin"))

    def ratio(i):
        a, b, c, e = (f"{fn}_{v}_{i}" for v in ("temp", "light") for fn in ("cos", "sin"))
        cross = f"sqrt(pow(sum({a} * {c} + {b} * {e}) OVER w, 2) + pow(sum({b} * {c} - {a} * {e}) OVER w, 2))"
        own = f"(sum({a} * {a} + {b} * {b}) OVER w * sum({c} * {c} + {e} * {e}) OVER w)"
        return f"CASE WHEN {own} > 0 THEN {cross} / sqrt(nullif({own}, 0)) ELSE 0 END AS coherence_{i}"

    return f"""WITH o AS MATERIALIZED (SELECT entity, ts, temp, light, row_number() OVER ({WIN}) AS i FROM climate),
       t AS MATERIALIZED (SELECT a.entity, a.ts, any_value(a.temp) AS temp, any_value(a.light) AS light, {made} FROM o a JOIN o b ON a.entity = b.entity AND abs(a.i - b.i) <= {9 * max(COHERENCE_SCALES)} GROUP BY a.entity, a.ts)
       SELECT entity, ts, temp, light, {', '.join(map(ratio, range(len(COHERENCE_SCALES))))} FROM t WINDOW w AS ({WIN} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"""


@query("X-14", "wavelet_coherence", views="climate", r="temp light coherence_0 coherence_1", digits=5, sql=_coherence_sql(4))
def _(v):
    return spx.coherence(v.climate.select("entity", "ts", "temp", "light"), "temp", "light", COHERENCE_SCALES, 4, "entity", chunk=None)


@query("X-15", "features_minimal", views="readings", r="sum mean std var rms max abs_max min median", i="length", digits=5,
       sql="""SELECT entity, sum(value) AS sum, avg(value) AS mean, count(value) AS length, stddev_pop(value) AS std, var_pop(value) AS var, sqrt(avg(value * value)) AS rms, max(value) AS max, max(abs(value)) AS abs_max, min(value) AS min, median(value) AS median FROM readings GROUP BY entity""")
def _(v):
    return ft.minimal(v.readings, "value", "entity", chunk=v.split("entity"))


SERIES = """s AS (SELECT entity, ts, value AS v, avg(value) OVER (PARTITION BY entity) AS mean, stddev_pop(value) OVER (PARTITION BY entity) AS std, count(*) OVER (PARTITION BY entity) AS n, row_number() OVER w AS i,
 lag(value) OVER w AS p, lag(value, 2) OVER w AS p2, lead(value) OVER w AS n1 FROM readings WINDOW w AS (PARTITION BY entity ORDER BY ts)),
g AS (SELECT *, sum(st) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT *, CASE WHEN sign(v - mean) IS DISTINCT FROM sign(p - mean) THEN 1 ELSE 0 END AS st FROM s)),
f AS (SELECT *, count(*) OVER (PARTITION BY entity, no) AS run FROM g)"""
DUCK = {
    "abs_energy": "sum(v * v)", "abs_sum_of_changes": "sum(abs(v - p))", "mean_abs_change": "avg(abs(v - p))", "mean_change": "avg(v - p)",
    "mean_second_derivative": "avg((n1 - 2 * v + p) / 2)", "cid_ce": "sqrt(sum(pow(v - p, 2)))", "count_above_mean": "count(*) FILTER (v > mean)",
    "count_below_mean": "count(*) FILTER (v < mean)", "longest_strike_above_mean": "coalesce(max(run) FILTER (v > mean), 0)",
    "longest_strike_below_mean": "coalesce(max(run) FILTER (v < mean), 0)", "first_location_of_max": "arg_min((i - 1) / n, (-v, i))",
    "first_location_of_min": "arg_min((i - 1) / n, (v, i))", "last_location_of_max": "arg_min(i / n, (-v, -i))", "last_location_of_min": "arg_min(i / n, (v, -i))",
    "c3_1": "avg(v * p * p2)", "time_reversal_asymmetry_1": "avg(v * v * p - p * p2 * p2)", "ratio_beyond_1_sigma": "count(*) FILTER (abs(v - mean) > std) / count(*)",
    "ratio_beyond_2_sigma": "count(*) FILTER (abs(v - mean) > 2 * std) / count(*)", "trend_slope": "regr_slope(v, i - 1)", "trend_intercept": "regr_intercept(v, i - 1)",
    "crossings_mean": "count(*) FILTER ((v > mean) <> (p > mean))", "peaks_1": "count(*) FILTER (v > p AND v > n1)",
    "variance_larger_than_std": "max((std * std > std)::INT)", "large_std_ratio": "max(std) / nullif(max(v) - min(v), 0)",
}
COUNTS = "count_above_mean count_below_mean longest_strike_above_mean longest_strike_below_mean crossings_mean peaks_1 variance_larger_than_std"


@query("X-16", "features_efficient", views="readings", r=" ".join(n for n in DUCK if n not in COUNTS.split()), i=COUNTS, digits=3,
       sql=f"WITH {SERIES} SELECT entity, " + ", ".join(f"{e} AS {n}" for n, e in DUCK.items()) + " FROM f GROUP BY entity")
def _(v):
    return ft.extract(v.readings, "value", "entity", ft.EFFICIENT, chunk=v.split("entity"))


TENTHS = [10, 20, 30, 40, 60, 70, 80, 90]


@query("X-16", "features_distribution", views="readings_n", r="binned_entropy " + " ".join(f"quantile_{q}" for q in TENTHS),
       sql="""WITH b AS (SELECT entity, value AS v, min(value) OVER w AS lo, max(value) OVER w AS hi FROM readings_n WHERE value IS NOT NULL WINDOW w AS (PARTITION BY entity)),
       c AS (SELECT entity, least(floor((v - lo) / nullif(hi - lo, 0) * 10), 9) AS part, count(*) AS c FROM b GROUP BY ALL),
       e AS (SELECT entity, -sum(c / t * ln(c / t)) AS binned_entropy FROM (SELECT *, sum(c) OVER (PARTITION BY entity) AS t FROM c) GROUP BY entity)
       SELECT entity, any_value(binned_entropy) AS binned_entropy, """ + ", ".join(f"quantile_cont(value, {q / 100}) AS quantile_{q}" for q in TENTHS) + """
       FROM readings_n JOIN e USING (entity) WHERE value IS NOT NULL GROUP BY entity""")
def _(v):
    return ft.distribution_features(v.readings_n, "value", "entity", chunk=v.split("entity", of="readings_n"))


@query("X-16", "features_duplicates", views="readings", r="reoccurring_values reoccurring_points distinct_share sum_of_reoccurring_values",
       sql="""WITH c AS (SELECT signal, value AS v, count(*) AS c FROM readings GROUP BY ALL) SELECT signal, arg_max(c, v) > 1 AS has_duplicate_max, arg_min(c, v) > 1 AS has_duplicate_min, bool_or(c > 1) AS has_duplicate,
       count(*) FILTER (c > 1) / count(*) AS reoccurring_values, coalesce(sum(c) FILTER (c > 1), 0) / sum(c) AS reoccurring_points, count(*) / sum(c) AS distinct_share, coalesce(sum(v) FILTER (c > 1), 0) AS sum_of_reoccurring_values FROM c GROUP BY signal""")
def _(v):
    return ft.duplicate_features(v.readings, "value", "signal")


@query("X-16", "features_energy_chunks", views="readings", r="energy_share", i="part",
       sql="""SELECT entity, floor((i - 1) * 5 / n) AS part, sum(v * v) / any_value(e) AS energy_share FROM (SELECT entity, value AS v, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, count(*) OVER (PARTITION BY entity) AS n, sum(value * value) OVER (PARTITION BY entity) AS e FROM readings) GROUP BY 1, 2""")
def _(v):
    return ft.energy_chunks(v.readings, "value", "entity", 5, chunk=v.split("entity"))


@query("X-16", "features_counts", views="readings", i="range_0 range_1 value_0",
       sql="SELECT entity, count(*) FILTER (value >= 0 AND value < 10) AS range_0, count(*) FILTER (value >= 10 AND value < 50) AS range_1, count(*) FILTER (value = 0) AS value_0 FROM readings GROUP BY entity")
def _(v):
    return ft.range_count(v.readings, "value", "entity", [(0, 10), (10, 50)], [0.0])


@query("X-16", "features_support_peaks", views="climate", i="peaks_3",
       sql=f"""SELECT entity, count(*) FILTER (nl = 3 AND nr = 3 AND temp > ml AND temp > mr) AS peaks_3 FROM (SELECT entity, temp, count(*) OVER l AS nl, count(*) OVER r AS nr, max(temp) OVER l AS ml, max(temp) OVER r AS mr FROM climate
       WINDOW l AS ({WIN} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS ({WIN} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) GROUP BY entity""")
def _(v):
    return ft.support_peaks(v.climate, "temp", 3, "entity", chunk=None)


@query("X-17", "features_profiled", views="readings", r="value", digits=3,
       sql=f"""WITH m AS (SELECT signal, sum(value) AS sum, avg(value) AS mean, count(value)::DOUBLE AS length, stddev_pop(value) AS std, var_pop(value) AS var, sqrt(avg(value * value)) AS rms, max(value) AS max, max(abs(value)) AS abs_max, min(value) AS min FROM readings GROUP BY signal),
       {SERIES.replace('entity', 'signal').replace('FROM readings', "FROM (SELECT * FROM readings WHERE signal = 'click')")}, e AS (SELECT signal, {', '.join(f'({x})::DOUBLE AS {n}' for n, x in DUCK.items())} FROM f GROUP BY signal)
       SELECT signal, feature, value FROM (UNPIVOT m ON COLUMNS(* EXCLUDE signal) INTO NAME feature VALUE value) UNION ALL SELECT signal, feature, value FROM (UNPIVOT e ON COLUMNS(* EXCLUDE signal) INTO NAME feature VALUE value)""")
def _(v):
    return ft.extract_profiled(v.readings, "value", (), "signal", ["click"], chunk=v.split("signal"))


@query("X-18", "features_impute_matrix", views="wide", r="click error",
       sql="""SELECT entity, hour, coalesce(click, (SELECT median(click) FROM wide)) AS click, coalesce(error, (SELECT median(error) FROM wide)) AS error FROM wide""")
def _(v):
    return ft.impute_matrix(v.wide.select("entity", "hour", "click", "error"), ["click", "error"])


def hourly_by_signal(v):
    from ...operators import grid as og
    from .grid import dense

    return og.ffill(dense(v), "value", "signal", chunk=None)


FILLED = f"""{DENSE},
filled AS (SELECT signal, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY signal ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM dense)"""


def optimal_partition(rows: str, key: str, value: str, cost: str, penalty: float, size: int) -> str:
    """Dynamic programming over all starts of the last segment, ``cost`` from s to e with sums one[] and two[] up to a reading."""
    reach = f"CASE WHEN (s = 0 OR s >= {size}) AND r.t + 1 - s >= {size} THEN r.best[s + 1] + {cost} ELSE 'inf'::DOUBLE END"
    return f"""x AS (SELECT {key}, ts, {value} AS value, row_number() OVER w - 1 AS i, sum({value}) OVER w AS s1, sum({value} * {value}) OVER w AS s2 FROM {rows} WINDOW w AS (PARTITION BY {key} ORDER BY ts)),
    c AS MATERIALIZED (SELECT {key}, list_concat([0.0::DOUBLE], list(s1::DOUBLE ORDER BY i)) AS one, list_concat([0.0::DOUBLE], list(s2::DOUBLE ORDER BY i)) AS two FROM x GROUP BY {key}),
    r AS (SELECT {key}, 0 AS t, [-{penalty}::DOUBLE] AS best, [0::BIGINT] AS cut FROM c
        UNION ALL SELECT {key}, t, list_append(best, list_min(reach) + {penalty}), list_append(cut, list_position(reach, list_min(reach)) - 1) FROM (
            SELECT c.{key}, r.t + 1 AS t, r.best, r.cut, list_transform(range(0, r.t + 1), lambda s: {reach}) AS reach FROM r JOIN c ON c.{key} = r.{key} AND r.t < len(c.one) - 1)),
    e AS (SELECT r.{key}, r.cut FROM c JOIN r ON c.{key} = r.{key} AND r.t = len(c.one) - 1),
    b AS (SELECT {key}, cut[len(cut)] AS i FROM e UNION ALL SELECT e.{key}, e.cut[b.i + 1] FROM b JOIN e ON e.{key} = b.{key} AND b.i > 0),
    m AS (SELECT x.{key}, x.ts, x.value, b.i IS NOT NULL AS is_break FROM x LEFT JOIN b ON b.{key} = x.{key} AND b.i = x.i AND b.i > 0)
    SELECT {key}, ts, value AS {value}, is_break, sum(is_break::INT) OVER (PARTITION BY {key} ORDER BY ts) AS era_id FROM m"""


@query("E-06", "changepoint_pelt_l2", views="grid", r="value", i="era_id",
       sql=f"WITH {FILLED}, " + optimal_partition("filled", "signal", "value", "c.two[r.t + 2] - c.two[s + 1] - (c.one[r.t + 2] - c.one[s + 1]) ** 2 / (r.t + 1 - s)", 200.0, 24))
def _(v):
    d = ch.pelt(hourly_by_signal(v), "value", "signal", model="l2", penalty=200.0, min_size=24)
    return sg.apply_breaks(d, "is_break", "signal", chunk=None)


@query("E-06", "changepoint_pelt_rbf", views="grid")
def _(v):
    d = ch.pelt(hourly_by_signal(v), "value", "signal", model="rbf", penalty=10.0, min_size=48)
    return sg.apply_breaks(d, "is_break", "signal", chunk=None)


SEGMENT_SUM = "(c.one[r.t + 2] - c.one[s + 1])"


@query("E-06,E-13", "changepoint_pelt_poisson", views="climate", r="n", i="era_id",
       sql="WITH " + optimal_partition("(SELECT entity, ts, n::DOUBLE AS n FROM climate)", "entity", "n",
                                       f"CASE WHEN {SEGMENT_SUM} > 0 THEN {SEGMENT_SUM} - {SEGMENT_SUM} * ln({SEGMENT_SUM} / (r.t + 1 - s)) ELSE 0 END", 5.0, 7))
def _(v):
    daily = v.climate.select("entity", "ts", F.col("n").cast("double").alias("n"))
    d = ch.pelt(daily, "n", "entity", model="poisson", penalty=5.0, min_size=7)
    return sg.apply_breaks(d, "is_break", "entity", chunk=None)


# every run length is kept: mass, and mean, strength, shape and rate of the Normal-Gamma
RUNS = """o AS MATERIALIZED (SELECT signal, ts, value, row_number() OVER (PARTITION BY signal ORDER BY ts) AS n FROM filled),
    r AS (SELECT signal, 0::BIGINT AS n, 0.0::DOUBLE AS cp_prob, [{'m': 1.0::DOUBLE, 'mu': 0.0::DOUBLE, 'k': 1.0::DOUBLE, 'a': 1.0::DOUBLE, 'b': 1.0::DOUBLE}] AS s FROM o WHERE n = 1
        UNION ALL SELECT signal, n, CASE WHEN n > 1 THEN w[1] / list_sum(w) ELSE 0.0 END,
            list_concat([{'m': 0.01::DOUBLE, 'mu': 0.0::DOUBLE, 'k': 1.0::DOUBLE, 'a': 1.0::DOUBLE, 'b': 1.0::DOUBLE}],
                list_transform(s, lambda q, i: {'m': w[i] / list_sum(w), 'mu': (q.k * q.mu + v) / (q.k + 1), 'k': q.k + 1, 'a': q.a + 0.5, 'b': q.b + q.k * (v - q.mu) ** 2 / (2 * (q.k + 1))}))
        FROM (SELECT o.signal, o.n, o.value AS v, r.s, list_transform(r.s, lambda q, i: q.m * CASE WHEN i = 1 THEN 1.0 ELSE 0.99 END
                * exp(lgamma(q.a + 0.5) - lgamma(q.a) - 0.5 * ln(2 * pi() * q.b * (q.k + 1) / q.k) - (q.a + 0.5) * ln(1 + (o.value - q.mu) ** 2 / (2 * q.b * (q.k + 1) / q.k)))) AS w
              FROM r JOIN o ON o.signal = r.signal AND o.n = r.n + 1))
    SELECT o.signal, o.ts, o.value, r.cp_prob, sum((r.cp_prob > 0.5)::INT) OVER (PARTITION BY o.signal ORDER BY o.ts) AS era_id FROM o JOIN r USING (signal, n)"""


@query("E-07,E-10", "changepoint_bocpd", views="grid", r="value cp_prob", i="era_id", sql=f"WITH {FILLED}, {RUNS}")
def _(v):
    d = ch.bocpd(hourly_by_signal(v), "value", "signal", lam=100.0)
    return sg.apply_breaks(d, F.col("cp_prob") > 0.5, "signal", chunk=None)


STATES, SYMBOLS = 3, 4
GIVEN = ([[0.92, 0.05, 0.03], [0.06, 0.87, 0.07], [0.02, 0.09, 0.89]], [[0.55, 0.25, 0.13, 0.07], [0.17, 0.41, 0.31, 0.11], [0.05, 0.19, 0.29, 0.47]], [0.5, 0.3, 0.2])

SEEN = f"""{FILLED},
o AS MATERIALIZED (SELECT signal, ts, row_number() OVER (PARTITION BY signal ORDER BY ts) AS n, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE round((value - lo) / (hi - lo) * 3)::INT END AS symbol
      FROM filled JOIN (SELECT signal, min(value) AS lo, max(value) AS hi FROM filled GROUP BY signal) USING (signal))"""


def best_path(a, b, pi) -> str:
    """The most likely states with given parameters, step by step."""
    emit = lambda j: f"ln([{', '.join(map(str, b[j]))}][o.symbol + 1]::DOUBLE)"
    into = lambda j: "[" + ", ".join(f"r.score[{i + 1}] + ln({a[i][j]}::DOUBLE)" for i in range(STATES)) + "]"
    js = range(STATES)
    return f"""r AS (SELECT signal, n, [{', '.join(f"ln({pi[j]}::DOUBLE) + {emit(j)}" for j in js)}] AS score, [0::BIGINT, 0, 0] AS came FROM o WHERE n = 1
        UNION ALL SELECT o.signal, o.n, [{', '.join(f"list_max({into(j)}) + {emit(j)}" for j in js)}], [{', '.join(f"list_position({into(j)}, list_max({into(j)}))" for j in js)}]
        FROM r JOIN o ON o.signal = r.signal AND o.n = r.n + 1),
    p AS (SELECT signal, n, came, list_position(score, list_max(score)) AS state FROM (SELECT *, max(n) OVER (PARTITION BY signal) AS last FROM r) WHERE n = last
        UNION ALL SELECT r.signal, r.n, r.came, p.came[p.state] FROM p JOIN r ON r.signal = p.signal AND r.n = p.n - 1)
    SELECT o.signal, o.ts, o.symbol, p.state - 1 AS state FROM o JOIN p USING (signal, n)"""


def one_fit(k: int) -> str:
    """Iteration ``k``: forward and backward probabilities of all readings with the parameters of the one before, and the new parameters."""
    i_s, j_s = range(STATES), range(SYMBOLS)
    was = f"p{k - 1}"
    emit = lambda j, o: f"p.b[{j * SYMBOLS + 1} + {o}.symbol]"
    even = lambda x: f"list_transform({x}, lambda u: u / list_sum({x}))"
    gamma = lambda i: f"f.x[{i + 1}] * g.x[{i + 1}]"
    step = lambda i, j: f"e.x[{i + 1}] * p.a[{i * STATES + j + 1}] * {emit(j, 'o')} * g.x[{j + 1}]"
    steps = [step(i, j) for i in i_s for j in i_s]
    return f"""f{k} AS (SELECT signal, n, {even('y')} AS x FROM (SELECT o.signal, o.n, [{', '.join(f"p.pi[{j + 1}] * {emit(j, 'o')}" for j in i_s)}] AS y FROM o JOIN {was} p USING (signal) WHERE o.n = 1)
        UNION ALL SELECT signal, n, {even('y')} FROM (SELECT o.signal, o.n, [{', '.join('(' + ' + '.join(f"r.x[{i + 1}] * p.a[{i * STATES + j + 1}]" for i in i_s) + f") * {emit(j, 'o')}" for j in i_s)}] AS y
            FROM f{k} r JOIN o ON o.signal = r.signal AND o.n = r.n + 1 JOIN {was} p ON p.signal = r.signal)),
    g{k} AS (SELECT signal, max(n) AS n, [1.0::DOUBLE, 1.0, 1.0] AS x FROM o GROUP BY signal
        UNION ALL SELECT signal, n, {even('y')} FROM (SELECT o.signal, o.n - 1 AS n, [{', '.join(' + '.join(f"p.a[{i * STATES + j + 1}] * {emit(j, 'o')} * r.x[{j + 1}]" for j in i_s) for i in i_s)}] AS y
            FROM g{k} r JOIN o ON o.signal = r.signal AND o.n = r.n JOIN {was} p ON p.signal = r.signal WHERE o.n > 1)),
    m{k} AS (SELECT signal, n, symbol, {even('y')} AS y FROM (SELECT o.signal, o.n, o.symbol, [{', '.join(gamma(i) for i in i_s)}] AS y FROM o JOIN f{k} f USING (signal, n) JOIN g{k} g USING (signal, n))),
    t{k} AS (SELECT signal, {even('y')} AS y FROM (SELECT o.signal, [{', '.join(steps)}] AS y FROM o JOIN f{k} e ON e.signal = o.signal AND e.n = o.n - 1 JOIN g{k} g ON g.signal = o.signal AND g.n = o.n JOIN {was} p ON p.signal = o.signal)),
    p{k} AS (SELECT signal, list_transform(a, lambda x, q: x / list_sum(a[(q - 1) // {STATES} * {STATES} + 1:(q - 1) // {STATES} * {STATES} + {STATES}])) AS a,
            list_transform(b, lambda x, q: x / list_sum(b[(q - 1) // {SYMBOLS} * {SYMBOLS} + 1:(q - 1) // {SYMBOLS} * {SYMBOLS} + {SYMBOLS}])) AS b, pi FROM
        (SELECT signal, [{', '.join(f"sum(y[{q + 1}]) + 1e-9" for q in range(STATES * STATES))}] AS a FROM t{k} GROUP BY signal) JOIN
        (SELECT signal, [{', '.join(f"coalesce(sum(y[{i + 1}]) FILTER (symbol = {j}), 0) + 1e-6" for i in i_s for j in j_s)}] AS b, [{', '.join(f"sum(y[{i + 1}]) FILTER (n = 1)" for i in i_s)}] AS pi FROM m{k} GROUP BY signal) USING (signal))"""


def listed(params) -> str:
    return ", ".join("[" + ", ".join(f"{x}::DOUBLE" for row in p for x in (row if isinstance(row, list) else [row])) + f"] AS {n}" for p, n in zip(params, ("a", "b", "pi")))


PARAMETERS = [("a", STATES * STATES), ("b", STATES * SYMBOLS), ("pi", STATES)]


@query("E-09", "changepoint_hmm_fit", views="grid", r="value", i="place",
       sql=f"WITH RECURSIVE {SEEN}, p0 AS (SELECT DISTINCT signal, {listed(GIVEN)} FROM o), {one_fit(1)}, {one_fit(2)}, p AS (SELECT * FROM p2) "
           + " UNION ALL ".join(f"SELECT signal, '{n}' AS part, unnest(range(0, {k})) AS place, unnest({n}) AS value FROM p" for n, k in PARAMETERS))
def _(v):
    """Two iterations from given parameters, over parts of 100 readings."""
    q = sg.quantize(hourly_by_signal(v), "value", SYMBOLS - 1, "signal")
    fit = ch.hmm_fit(ch.hmm_chunks(q, "symbol", "signal", size=100, chunk=None), "signal", STATES, SYMBOLS, 2, GIVEN)
    return fit.select("signal", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.lit(i).alias("place"), F.col(n)[i].alias("value")) for n, k in PARAMETERS for i in range(k)])).alias("x")).select("signal", "x.*")


@query("E-09", "changepoint_hmm_path", views="grid", i="symbol state", sql=f"WITH {SEEN}, {best_path(*GIVEN)}")
def _(v):
    """The path with given parameters, decoded in parts of 100 readings."""
    q = sg.quantize(hourly_by_signal(v), "value", SYMBOLS - 1, "signal")
    parts = ch.hmm_chunks(q, "symbol", "signal", size=100, chunk=None)
    given = parts.select("signal").distinct().select("signal", *[F.array(*[F.lit(x) for row in p for x in (row if isinstance(row, list) else [row])]).alias(n) for p, n in zip(GIVEN, ("a", "b", "pi"))])
    return ch.hmm_path(parts, given, "signal", STATES)


@query("E-09", "changepoint_hmm", views="grid")
def _(v):
    q = sg.quantize(hourly_by_signal(v), "value", SYMBOLS - 1, "signal")
    d = ch.hmm_states(q, "symbol", "signal", STATES, SYMBOLS, chunk=None)
    return sg.segments_from_labels(d, "state", "signal", chunk=None)


def long_spectra(n: int):
    """Magnitudes of consecutive blocks of n hours of every signal, one row per bin."""
    sql = f"""WITH {FILLED}, o AS (SELECT signal, value, row_number() OVER (PARTITION BY signal ORDER BY ts) - 1 AS i FROM filled),
       b AS (SELECT signal, i // {n} AS block, i % {n} AS t, value, count(*) OVER (PARTITION BY signal, i // {n}) AS size FROM o)
       SELECT signal, block, bin, sqrt(pow(sum(value * cos(2 * pi() * (bin * t % {n}) / {n})), 2) + pow(sum(value * sin(2 * pi() * (bin * t % {n}) / {n})), 2)) AS mag
       FROM b, generate_series(0, {n // 2 - 1}) g(bin) WHERE size = {n} GROUP BY ALL"""

    @query("X-11", f"spectral_blocks_{n}", views="grid", r="mag", i="block bin", sql=sql)
    def _(v):
        rows = scan(hourly_by_signal(v), "signal", "ts", {"i": running_count()}, chunk=None)
        blocks = cx.blocks(rows, "value", "signal", floor_div(F.col("i") - 1, n).alias("block"), size=n)
        return spx.magnitudes(blocks, n).select("signal", "block", F.posexplode("mag").alias("bin", "mag"))


long_spectra(360)
long_spectra(97)  # a prime
