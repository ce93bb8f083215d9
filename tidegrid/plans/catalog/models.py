"""Feature selection, model input and metrics, solution tables, quality checks."""

from pyspark.sql import functions as F

from ...operators import model as om
from ...operators import pareto as op
from ...operators import quality as oq
from ...operators import select as osl
from ...sources.tables import scratch
from ..registry import query

CL = ("temp", "out_temp", "rh", "light", "co2", "power")


@query("M-01,M-02", "select_dispersion", views="climate", r="variance mean dispersion", digits=4,
       sql=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_samp({c}) AS variance, avg({c}) AS mean, var_samp({c}) / abs(avg({c})) AS dispersion FROM climate" for c in CL))
def _(v):
    return osl.column_dispersion(v.climate, CL)


@query("M-01,M-02", "select_drop_low", views="climate", r="out_temp rh light co2 power",
       sql="SELECT entity, ts, out_temp, rh, light, co2, power FROM (SELECT * FROM climate)")
def _(v):
    d = v.climate.select("entity", "ts", F.lit(1.0).alias("flat"), *CL[1:])
    return osl.drop_low(osl.drop_low(d, ["flat", *CL[1:]]), CL[1:], by="dispersion", threshold=0.01)


for _rule, _kept in (("later", "temp"), ("variance", "twice"), ("mean_corr", "temp")):
    @query("M-03", f"select_uncorrelated_{_rule}", views="climate", r=f"{_kept} rh",
           sql=f"SELECT entity, ts, {'temp * 2 AS twice' if _kept == 'twice' else 'temp'}, rh FROM climate")
    def _(v, rule=_rule):
        d = v.climate.select("entity", "ts", "temp", (F.col("temp") * 2).alias("twice"), "rh")
        return osl.drop_correlated(d, ["temp", "twice", "rh"], 0.95, rule) if rule != "mean_corr" else osl.drop_correlated(
            d.withColumn("twice", F.col("temp") * 2 + F.col("rh") * 0.01), ["temp", "twice", "rh"], 0.95, rule)


@query("M-05", "select_complete", views="wide", r="click view",
       sql="""SELECT entity, hour, coalesce(click, (SELECT median(click) FROM wide)) AS click, coalesce("view", (SELECT median("view") FROM wide)) AS "view" FROM wide""")
def _(v):
    d = v.wide.select("entity", "hour", "click", "view", F.when(F.col("click") > 1e6, 1.0).alias("empty"))
    return osl.complete_and_fill(d, ["click", "view", "empty"], 0.05)


@query("M-04", "select_fdr", views="climate")
def _(v):
    d = v.climate.withColumn("noise", F.lit(1.0) * F.col("entity"))
    kept = osl.select_fdr(d, ["temp", "rh", "light", "noise"], "power", 0.05)
    return d.select("entity", "ts", "power", *kept)


@query("M-10", "model_time_split", views="readings",
       sql="""SELECT event_id, CASE WHEN b < 0.7 THEN 'train' WHEN b < 0.85 THEN 'valid' ELSE 'test' END AS part FROM (SELECT event_id, (rank() OVER (ORDER BY ts) - 1) / count(*) OVER () AS b FROM readings)""")
def _(v):
    return om.time_split(v.readings, "ts", chunk=v.split(of="readings")).select("event_id", "part")


@query("M-10", "model_folds", views="readings", i="fold rows",
       sql="""WITH b AS (SELECT event_id, floor((rank() OVER (ORDER BY ts) - 1) / count(*) OVER () * 5)::INT AS b FROM readings)
       SELECT fold, CASE WHEN b = fold THEN 'valid' ELSE 'train' END AS role, count(*) AS rows FROM b, generate_series(1, 4) g(fold) WHERE b <= fold GROUP BY ALL""")
def _(v):
    return om.expanding_folds(v.readings, 4, "ts", chunk=v.split(of="readings")).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"))


@query("M-13", "model_metrics", views="climate", r="rmse mae r2 mape r", i="n", digits=4,
       sql="""SELECT entity, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(temp) * count(*)) AS r2, avg(abs(e / nullif(temp, 0))) * 100 AS mape, corr(temp, p) AS r
       FROM (SELECT entity, temp, out_temp * 1.5 + 5 AS p, temp - (out_temp * 1.5 + 5) AS e FROM climate) GROUP BY entity""")
def _(v):
    return om.metrics(v.climate.withColumn("p", F.col("out_temp") * 1.5 + 5), "temp", "p", "entity").drop("p_value")


@query("M-13", "model_p_value", views="climate")
def _(v):
    return om.metrics(v.climate.withColumn("p", F.col("out_temp") * 1.5 + 5), "temp", "p", "entity").select("entity", "r", "p_value")


@query("M-16", "model_sequences", views="climate", r="first_temp last_rh", i="steps",
       sql="""SELECT entity, ts, 6 AS steps, lag(temp, 5) OVER w AS first_temp, rh AS last_rh FROM climate WINDOW w AS (PARTITION BY entity ORDER BY ts) QUALIFY count(*) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6""")
def _(v):
    s = om.sequences(v.climate, ["temp", "rh"], 6, "entity", chunk=None)
    return s.select("entity", "ts", F.size("sequence").alias("steps"), F.col("sequence")[0][0].alias("first_temp"), F.col("sequence")[5][1].alias("last_rh"))


@query("M-08", "model_complete_rows", views="wide", r="click view",
       sql='SELECT entity, hour, click, "view" FROM wide WHERE click IS NOT NULL AND "view" IS NOT NULL')
def _(v):
    target = om.resolve_target(v.wide, "vie")
    return om.complete_rows(v.wide, ["click", target]).select("entity", "hour", "click", target)


@query("M-09", "model_scaled", views="climate", r="z", digits=4,
       sql="SELECT entity, ts, (temp - avg(temp) OVER ()) / stddev(temp) OVER () AS z FROM climate")
def _(v):
    from pyspark.ml.functions import vector_to_array

    return om.scaled(v.climate, ["temp", "rh"])[1].select("entity", "ts", vector_to_array("features")[0].alias("z"))


@query("M-10,M-11,M-15", "model_boosted", views="climate")
def _(v):
    features, large = ["temp", "rh", "light", "n"], v.split(of="lines").found
    climate = v.written("climate", "ts", *features, "power") if large else v.climate
    d = om.time_split(climate, "ts", chunk=v.split(of="climate"), write=large)
    m = om.train_regressor(d, features, "power", part="part", rounds=5, depth=3)
    return om.metrics(om.score(m, d.where("part = 'test'")), "power", "prediction")


@query("M-12,M-15", "model_forest", views="climate")
def _(v):
    d = om.time_split(v.climate, "ts", chunk=v.split(of="climate"))
    m = om.train_regressor(d, ["temp", "rh", "light", "n"], "power", part="part", kind="forest", rounds=10, scale="robust")
    return om.metrics(om.score(m, d.where("part = 'test'")), "power", "prediction")


@query("M-15", "model_saved", views="climate", i="rows different",
       sql="SELECT count(*) AS rows, 0 AS different FROM climate WHERE temp IS NOT NULL AND rh IS NOT NULL AND light IS NOT NULL AND n IS NOT NULL AND power IS NOT NULL")
def _(v):
    cols = ["temp", "rh", "light", "n"]
    made = om.train_regressor(v.climate, cols, "power", kind="forest", rounds=5, scale="robust")
    again = om.load(om.save(made, scratch(v.spark) + "/model"))
    d = om.score(made, om.complete_rows(v.climate, [*cols, "power"])).withColumnRenamed("prediction", "first").drop("raw", "features")
    return om.score(again, d).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("first").eqNullSafe(F.col("prediction"))).alias("different"))


# ----------------------------------------------------------------------- solutions


FRONT = """m AS (SELECT run, algorithm, sol, f1 AS a, -f2 AS b FROM solutions), best AS (SELECT algorithm, a, min(b) AS b FROM m GROUP BY ALL),
front AS (SELECT algorithm, a, b FROM (SELECT *, min(b) OVER (PARTITION BY algorithm ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM best) WHERE pb IS NULL OR b < pb)"""


def mins(v):
    return op.minimised(v.solutions, {"f1": "min", "f2": "max"}).withColumnsRenamed({"f1": "a", "f2": "b"})


@query("P-01,J-16", "pareto_front", views="solutions", r="a b",
       sql="""WITH m AS (SELECT algorithm, sol, f1 AS a, -f2 AS b FROM solutions) SELECT * FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.algorithm = x.algorithm AND y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))""")
def _(v):
    return op.non_dominated(mins(v), "a", "b", "algorithm", chunk=v.split("algorithm", of="solutions")).select("algorithm", "sol", "a", "b")


@query("P-01,J-16", "pareto_front_three", views="solutions", r="a b c",
       sql="""WITH m AS (SELECT algorithm, sol, f1 AS a, -f2 AS b, (sol % 101)::DOUBLE AS c FROM solutions) SELECT * FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.algorithm = x.algorithm AND y.a <= x.a AND y.b <= x.b AND y.c <= x.c AND (y.a < x.a OR y.b < x.b OR y.c < x.c))""")
def _(v):
    d = mins(v).select("algorithm", "sol", "a", "b", (F.col("sol") % 101).cast("double").alias("c"))
    return op.front_many(d, ["a", "b", "c"], "algorithm", rows=500)


@query("P-02", "pareto_hypervolume", views="solutions", r="hypervolume", i="points", digits=3,
       sql=f"""WITH {FRONT} SELECT algorithm, sum((1000 - a) * (coalesce(p, 0) - b)) AS hypervolume, count(*) AS points FROM (SELECT *, lag(b) OVER (PARTITION BY algorithm ORDER BY a) AS p FROM front WHERE a < 1000 AND b < 0) GROUP BY algorithm""")
def _(v):
    return op.hypervolume(mins(v), "a", "b", (1000.0, 0.0), "algorithm", chunk=v.split("algorithm", of="solutions"))


SOME = FRONT.replace("FROM solutions)", "FROM solutions WHERE f2 <= 46)").replace("m AS", "m2 AS").replace("best AS", "best2 AS").replace("front AS", "fr AS").replace("FROM m ", "FROM m2 ").replace("FROM best)", "FROM best2)")


@query("P-03", "pareto_igd_plus", views="solutions", r="igd_plus",
       sql=f"""WITH {FRONT}, {SOME} SELECT algorithm, avg(d) AS igd_plus FROM (SELECT t.algorithm, t.a, t.b, min(sqrt(pow(greatest(f.a - t.a, 0), 2) + pow(greatest(f.b - t.b, 0), 2))) AS d FROM front t JOIN fr f USING (algorithm) GROUP BY ALL) GROUP BY algorithm""")
def _(v):
    m = mins(v)
    return op.igd_plus(op.front_points(m.where("b >= -46"), "a", "b", "algorithm", chunk=v.split("algorithm", of="solutions")), op.front_points(m, "a", "b", "algorithm", chunk=v.split("algorithm", of="solutions")), "a", "b", "algorithm", chunk=v.split("algorithm", of="solutions"))


@query("P-04", "pareto_epsilon", views="solutions", r="epsilon",
       sql=f"""WITH {FRONT}, {SOME} SELECT algorithm, max(e) AS epsilon FROM (SELECT t.algorithm, t.a, t.b, min(greatest(f.a - t.a, f.b - t.b)) AS e FROM front t JOIN fr f USING (algorithm) GROUP BY ALL) GROUP BY algorithm""")
def _(v):
    m = mins(v)
    return op.epsilon_indicator(op.front_points(m.where("b >= -46"), "a", "b", "algorithm", chunk=v.split("algorithm", of="solutions")), op.front_points(m, "a", "b", "algorithm", chunk=v.split("algorithm", of="solutions")), "a", "b", "algorithm", chunk=v.split("algorithm", of="solutions"))


THREE = "m AS MATERIALIZED (SELECT algorithm, sol, f1 AS a, -f2 AS b, (sol % 101)::DOUBLE AS c FROM solutions)"


def three(v):
    return mins(v).select("algorithm", "sol", "a", "b", (F.col("sol") % 101).cast("double").alias("c"))


@query("P-03", "pareto_igd_plus_three", views="solutions", r="igd_plus",
       sql=f"""WITH {THREE} SELECT algorithm, avg(d) AS igd_plus FROM (SELECT t.algorithm, t.sol, min(sqrt(pow(greatest(f.a - t.a, 0), 2) + pow(greatest(f.b - t.b, 0), 2) + pow(greatest(f.c - t.c, 0), 2))) AS d
       FROM m t JOIN m f ON f.algorithm = t.algorithm AND f.sol % 3 = 0 GROUP BY ALL) GROUP BY algorithm""")
def _(v):
    d = three(v)
    return op.igd_plus_many(d.where("sol % 3 = 0"), d, ["a", "b", "c"], "algorithm", chunk=v.split("algorithm", of="solutions"))


@query("P-04", "pareto_epsilon_three", views="solutions", r="epsilon",
       sql=f"""WITH {THREE} SELECT algorithm, max(e) AS epsilon FROM (SELECT t.algorithm, t.sol, min(greatest(f.a - t.a, f.b - t.b, f.c - t.c)) AS e
       FROM m t JOIN m f ON f.algorithm = t.algorithm AND f.sol % 3 = 0 GROUP BY ALL) GROUP BY algorithm""")
def _(v):
    d = three(v)
    return op.epsilon_many(d.where("sol % 3 = 0"), d, ["a", "b", "c"], "algorithm", chunk=v.split("algorithm", of="solutions"))


@query("P-05", "pareto_spacing", views="solutions", r="spacing",
       sql=f"""WITH {FRONT} SELECT algorithm, coalesce(stddev_pop(d), 0) AS spacing FROM (SELECT x.algorithm, x.a, min(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) AS d FROM front x LEFT JOIN front y ON x.algorithm = y.algorithm AND x.a <> y.a GROUP BY ALL) GROUP BY algorithm""")
def _(v):
    return op.spacing(mins(v), "a", "b", "algorithm", chunk=v.split("algorithm", of="solutions"))


@query("P-06", "pareto_spread", views="solutions", r="max_spread",
       sql="SELECT run, (max(f1) - min(f1)) / (100 + 1e-10) * (max(f2) - min(f2)) / (50 + 1e-10) AS max_spread FROM solutions GROUP BY run")
def _(v):
    return op.maximum_spread(v.solutions, "f1", "f2", "run", (100.0, 50.0))


@query("P-07", "pareto_convergence", views="solutions", r="improvement",
       sql="""WITH l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY sol DESC) AS r FROM solutions), g AS (SELECT run, count(*) AS n, max(f2) FILTER (r > 5) AS o, max(f2) FILTER (r <= 5) AS w FROM l WHERE r <= 10 GROUP BY run)
       SELECT run, CASE WHEN n = 10 THEN (w - o) / (o + 1e-10) END AS improvement, n = 10 AND (w - o) / (o + 1e-10) < 0.001 AS converged FROM g""")
def _(v):
    return op.convergence(v.solutions, "f2", "run", "sol", 10)


@query("P-08", "test_wilcoxon", views="climate", r="statistic z effect_r", i="n_pairs", digits=4,
       sql="""WITH d AS (SELECT round(temp - rh / 2, 6) AS d, abs(round(temp - rh / 2, 6)) AS a FROM climate WHERE round(temp - rh / 2, 6) <> 0), r AS (SELECT d, a, count(*) OVER (PARTITION BY a) AS t, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM d),
       g AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS wp, coalesce(sum(r) FILTER (d < 0), 0) AS wm, sum(t * t - 1) AS ties FROM r)
       SELECT n AS n_pairs, least(wp, wm) AS statistic, (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z,
       abs((least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) / sqrt(n) AS effect_r FROM g""")
def _(v):
    d = v.climate.select(F.round(F.col("temp") - F.col("rh") / 2, 6).alias("x"), F.lit(0.0).alias("y"))
    return op.wilcoxon(d, "x", "y", chunk=v.split(of="climate")).drop("p_value")


RANKS = "rk AS (SELECT algorithm, f2, count(*) OVER (PARTITION BY f2) AS t, rank() OVER (ORDER BY f2) + (count(*) OVER (PARTITION BY f2) - 1) / 2 AS r FROM src)"


@query("P-09,P-12", "test_mann_whitney", views="solutions", r="u a12 z effect_r", i="n_x n_y",
       sql=f"""WITH src AS (SELECT * FROM solutions WHERE algorithm IN ('ECONOMY', 'SMALL')), {RANKS}, g AS (SELECT count(*) FILTER (algorithm = 'ECONOMY') AS nx, count(*) FILTER (algorithm = 'SMALL') AS ny, sum(r) FILTER (algorithm = 'ECONOMY') AS r, sum(t * t - 1) AS ties FROM rk),
       u AS (SELECT *, r - nx * (nx + 1) / 2 AS u, nx + ny AS n FROM g), z AS (SELECT *, greatest(abs(u - nx * ny / 2) - 0.5, 0) / sqrt(nx * ny / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
       SELECT nx AS n_x, ny AS n_y, u, u / (nx * ny) AS a12, z, z / sqrt(n) AS effect_r,
       CASE WHEN u / (nx * ny) >= 0.71 THEN 'large' WHEN u / (nx * ny) >= 0.64 THEN 'medium' WHEN u / (nx * ny) >= 0.56 THEN 'small' WHEN u / (nx * ny) >= 0.44 THEN 'negligible' WHEN u / (nx * ny) >= 0.36 THEN 'small (reversed)' WHEN u / (nx * ny) >= 0.29 THEN 'medium (reversed)' ELSE 'large (reversed)' END AS band FROM z""")
def _(v):
    return op.mann_whitney(v.solutions, "f2", "algorithm", "ECONOMY", "SMALL", chunk=v.split(of="solutions")).drop("p_value")


@query("P-10", "test_kruskal", views="solutions", r="h", i="n_groups n_total",
       sql=f"""WITH src AS (SELECT * FROM solutions), {RANKS}, g AS (SELECT algorithm, count(*) AS n, sum(r) AS r FROM rk GROUP BY algorithm), t AS (SELECT count(*) AS n, sum(t * t - 1) AS ties FROM rk)
       SELECT (SELECT count(*) FROM g) AS n_groups, n AS n_total, (12 / (n * (n + 1)) * (SELECT sum(r * r / n) FROM g) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM t""")
def _(v):
    return op.kruskal_wallis(v.solutions, "f2", "algorithm", chunk=v.split(of="solutions")).drop("p_value")


@query("P-10", "test_friedman", views="solutions", r="chi2", i="n_blocks n_groups",
       sql="""WITH c AS (SELECT run, algorithm, avg(f2) AS v FROM solutions GROUP BY ALL), k AS (SELECT count(DISTINCT algorithm) AS k FROM c), f AS (SELECT c.* FROM c WHERE run IN (SELECT run FROM c GROUP BY run HAVING count(*) = (SELECT k FROM k))),
       r AS (SELECT run, algorithm, count(*) OVER (PARTITION BY run, v) AS t, rank() OVER (PARTITION BY run ORDER BY v) + (count(*) OVER (PARTITION BY run, v) - 1) / 2 AS r FROM f),
       s AS (SELECT algorithm, sum(r) AS r, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY algorithm), a AS (SELECT sum(r * r) AS s, max(n) AS n, sum(ties) AS ties, (SELECT k FROM k) AS k FROM s)
       SELECT n AS n_blocks, k AS n_groups, (12 / (n * k * (k + 1)) * s - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS chi2 FROM a""")
def _(v):
    cells = v.solutions.groupBy("run", "algorithm").agg(F.avg("f2").alias("v"))
    return op.friedman(cells, "v", "algorithm", "run").drop("p_value")


@query("P-11", "test_dunn", views="solutions", r="z",
       sql=f"""WITH src AS (SELECT * FROM solutions), {RANKS}, g AS (SELECT algorithm AS g, count(*) AS n, avg(r) AS m FROM rk GROUP BY algorithm), t AS (SELECT count(*) AS n, sum(t * t - 1) AS ties FROM rk)
       SELECT a.g AS group_a, b.g AS group_b, (a.m - b.m) / sqrt((t.n * (t.n + 1) / 12 - ties / (12 * (t.n - 1))) * (1 / a.n + 1 / b.n)) AS z FROM g a, g b, t WHERE a.g < b.g""")
def _(v):
    return op.dunn(v.solutions, "f2", "algorithm", chunk=v.split(of="solutions")).drop("p_adjusted")


@query("P-08,P-09,P-10,P-11", "test_p_values", views="solutions")
def _(v):
    k = op.kruskal_wallis(v.solutions, "f2", "algorithm", chunk=v.split(of="solutions")).select(F.lit("kruskal").alias("test"), "p_value")
    m = op.mann_whitney(v.solutions, "f2", "algorithm", "ECONOMY", "SMALL", chunk=v.split(of="solutions")).select(F.lit("mann_whitney"), "p_value")
    return k.union(m).union(op.dunn(v.solutions, "f2", "algorithm", chunk=v.split(of="solutions")).select(F.concat_ws("-", "group_a", "group_b"), "p_adjusted"))


@query("P-13", "pareto_quality", views="climate", r="energy_efficiency growth_effectiveness feasibility stability overall_quality",
       sql="""SELECT entity, ts, ee AS energy_efficiency, g AS growth_effectiveness, f AS feasibility, s AS stability, (ee + g + f + s) / 4 AS overall_quality FROM (SELECT entity, ts, 1 / (power + 1e-6) AS ee, light / 1000 AS g,
       ((temp BETWEEN 15 AND 30)::INT + (rh BETWEEN 40 AND 90)::INT + (co2 BETWEEN 400 AND 1200)::INT) / 3 AS f, greatest(((1 - abs(temp - 20) / 15) + (1 - abs(rh - 60) / 50)) / 2, 0) AS s FROM climate)""")
def _(v):
    d = op.solution_quality(v.climate.withColumn("g", F.col("light") / 1000), "power", "g", "temp", "rh", "co2", F.lit(20.0), F.lit(60.0))
    return d.select("entity", "ts", "energy_efficiency", "growth_effectiveness", "feasibility", "stability", "overall_quality")


# ------------------------------------------------------------------------- quality


@query("Q-02", "quality_failing", views="lines",
       sql="""SELECT orderkey, line, entity, ts, "check" FROM (SELECT orderkey, line, entity, ts, unnest(list_filter([CASE WHEN ts IS NULL THEN 'time_null' END, CASE WHEN NOT rh * 1.2 BETWEEN 0 AND 105 THEN 'rh_range' END, CASE WHEN NOT temp * 1.3 BETWEEN -50 AND 60 THEN 'temp_range' END], lambda x: x IS NOT NULL)) AS "check" FROM lines)""")
def _(v):
    d = v.lines.withColumns({"rh": F.col("rh") * 1.2, "temp": F.col("temp") * 1.3})
    return oq.failing_rows(d, oq.sensor_checks("ts", "rh", "temp"), ["orderkey", "line", "entity", "ts"])


@query("Q-03", "quality_suite", views="readings_n", r="observed",
       sql="""SELECT 'not_null:value' AS expectation, count(value) / count(*) AS observed, count(value) / count(*) >= 0.8 AS success FROM readings_n
       UNION ALL SELECT 'between:value', count(*) FILTER (value BETWEEN 0 AND 100) / count(value), count(*) FILTER (value BETWEEN 0 AND 100) / count(value) >= 0.95 FROM readings_n
       UNION ALL SELECT 'mean_between:value', avg(value), avg(value) BETWEEN 1 AND 50 FROM readings_n
       UNION ALL SELECT 'in_set:signal', 1.0, TRUE UNION ALL SELECT 'not_null:absent', NULL, FALSE""")
def _(v):
    E = oq.Expectation
    return oq.run_suite(v.readings_n, [E("not_null", "value", mostly=0.8), E("between", "value", 0, 100, 0.95), E("mean_between", "value", 1, 50),
                                       E("in_set", "signal", values=("click", "error", "purchase", "signup", "view")), E("not_null", "absent")])


@query("M-15", "model_pipeline_saved", views="readings_n", r="value value_mean value_max step",
       sql="""WITH c AS (SELECT event_id, signal, ts, least(greatest(value, 1), 50) AS value FROM readings_n WHERE value IS NOT NULL),
       w AS (SELECT *, avg(value) OVER r AS value_mean, max(value) OVER r AS value_max FROM c WINDOW r AS (PARTITION BY signal ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
       SELECT event_id, value, value_mean, value_max, value - lag(value) OVER (PARTITION BY signal ORDER BY ts, event_id) AS step FROM w""")
def _(v):
    """Clean, window and lag steps in one pipeline model that is saved and loaded before it is used."""
    from pyspark.ml import Pipeline, PipelineModel

    from ...sources.tables import scratch
    from ...steps import Step

    data, keys, order = v.readings_n.where("value IS NOT NULL").select("event_id", "signal", "ts", "value"), ["signal"], ["ts", "event_id"]
    whole = Pipeline(stages=[
        Step(function="operators.clean:clip_outliers", arguments={"rules": {"value": [1.0, 50.0]}}),
        Step(function="operators.rolling:rolling_rows", arguments={"col": "value", "n": 12, "stats": ["mean", "max"], "keys": keys, "order": order}),
        Step(function="operators.join:lagged", arguments={"col": "value", "lags": [1], "keys": keys, "order": order})]).fit(data)
    path = scratch(v.spark) + "/pipeline"
    whole.write().save(path)
    made = PipelineModel.load(path).transform(data)
    return made.select("event_id", "value", "value_mean", "value_max", (F.col("value") - F.col("value_lag_1")).alias("step"))
