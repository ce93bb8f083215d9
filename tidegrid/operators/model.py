"""Model input, splits, training with MLlib, metrics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import HOUR, attach_row, cols, epoch, floor_div, is_plain, match, row_frames, value_ranks
from ..functions.stats import corr
from ..functions.tails import t_two_sided
from ..sources.tables import stage

EPS = 1e-8


def cross_level(df: DataFrame, pairs: Mapping[str, str], durations: tuple[str, str] | None = None) -> DataFrame:
    """Ratio and difference of a feature and its parent-level twin, and the ratio of era lengths."""
    made = {}
    for child, parent in pairs.items():
        made[f"{child}_ratio"] = F.col(child) / (F.col(parent) + EPS)
        made[f"{child}_diff"] = (F.col(child) - F.col(parent)).cast("double")
    if durations:
        made["duration_ratio"] = F.col(durations[0]) / (F.col(durations[1]) + EPS)
    return df.withColumns(made)


def concat_levels(frames: Mapping[str, DataFrame], tag: str = "level") -> DataFrame:
    """Stack frames with differing columns, each row tagged with its level."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def resolve_target(df: DataFrame, wanted: str) -> str:
    """The column named ``wanted``, else the first one containing it."""
    if wanted in df.columns:
        return wanted
    near = [c for c in df.columns if wanted.lower() in c.lower()]
    if not near:
        raise ValueError(f"no column for target {wanted}")
    return near[0]


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def time_rank(df: DataFrame, ts: str = "ts", name: str = "time_rank", chunk="spread", write: bool = False) -> DataFrame:
    """Share of rows before each row's time, from merged timestamps: no global sort in one task.

    With ``write`` the shares of the times are written first. Spark then knows before it joins whether they are few, and need not shuffle the rows.
    """
    t = df.withColumn("_t", epoch(ts))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    # instants are close together in relative size: bucket them by the hour
    part = chunk if is_plain(chunk) else floor_div(F.col("_t"), HOUR)
    ranks = attach_row(value_ranks(t, (), "_t", part), total).select("_t", (F.col("below") / F.col("_total")).alias(name))
    return t.transform(match, stage(ranks, "ranks") if write else ranks, "_t").drop("_t")


def time_split(df: DataFrame, ts: str = "ts", train: float = 0.7, valid: float = 0.15, chunk="spread", write: bool = False) -> DataFrame:
    """Column ``part``: the earliest rows train, the next validate, the last test."""
    r = F.col("time_rank")
    return time_rank(df, ts, chunk=chunk, write=write).withColumn("part", F.when(r < train, "train").when(r < train + valid, "valid").otherwise("test")).drop("time_rank")


def expanding_folds(df: DataFrame, folds: int, ts: str = "ts", chunk="spread") -> DataFrame:
    """Rows per fold of an expanding-window cross-validation: fold k trains on blocks before k and validates on block k."""
    block = F.floor(F.col("time_rank") * (folds + 1)).cast("int")
    d = time_rank(df, ts, chunk=chunk).withColumn("_block", block)
    uses = F.sequence(F.greatest(F.col("_block"), F.lit(1)), F.lit(folds))
    out = d.withColumn("fold", F.explode(uses))
    return out.withColumn("role", F.when(F.col("_block") == F.col("fold"), "valid").otherwise("train")).drop("_block", "time_rank")


def scaled(df: DataFrame, features: Sequence[str], kind: str = "standard"):
    """Assemble and scale; returns the fitted pipeline and the scaled frame."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler

    make = {"standard": lambda: StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            "robust": lambda: RobustScaler(inputCol="raw", outputCol="features", withCentering=True, relativeError=0.0001)}[kind]
    fitted = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"), make()]).fit(df)
    return fitted, fitted.transform(df)


ROWS = 500_000  # training rows of a partition, which every pass of the training reads whole


@contextmanager
def dealt(df: DataFrame) -> Iterator[DataFrame]:
    """Rows dealt into partitions of about ``ROWS``, so that they grow in number and not in size; up to ``ROWS`` rows stay as they are.

    What is dealt is kept on disk until the end, as each pass of a training would compute and shuffle all of it again.
    """
    n = df.count()
    if n <= ROWS:
        yield df
        return
    kept = df.repartition(-(-n // ROWS)).persist(StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        kept.unpersist()


def train_regressor(df: DataFrame, features: Sequence[str], target: str, *, kind: str = "boosted", part: str | None = None,
                    rounds: int = 50, depth: int = 5, scale: str = "standard", seed: int = 7):
    """Fit scaling and a tree ensemble; boosting stops early on the ``valid`` part when there is one."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    data = complete_rows(df, [*features, target]).select(*dict.fromkeys([*features, target, *([part] if part else [])]))
    if kind == "boosted":
        tree = GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
        if part:
            data = data.where(F.col(part) != "test").withColumn("_valid", F.col(part) == "valid")
            tree = tree.setValidationIndicatorCol("_valid")
    else:
        data = data.where(F.col(part) == "train") if part else data
        tree = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=rounds, maxDepth=depth, seed=seed)
    scaler = (RobustScaler(inputCol="raw", outputCol="features") if scale == "robust"
              else StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    with dealt(data) as rows:
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), scaler, tree]).fit(rows)


def importances(model, features: Sequence[str], top: int | None = None) -> list[tuple[str, float]]:
    """Gain importances, largest first."""
    found = zip(features, model.stages[-1].featureImportances.toArray())
    return sorted(((n, float(v)) for n, v in found), key=lambda p: (-p[1], p[0]))[:top]


def score(model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def save(model, path: str) -> str:
    """Write a fitted pipeline where ``load`` finds it; an earlier one is replaced."""
    model.write().overwrite().save(path)
    return path


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def metrics(df: DataFrame, actual: str, predicted: str, keys=()) -> DataFrame:
    """RMSE, MAE, R², MAPE, Pearson r and its two-sided p-value."""
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    g = df.where(y.isNotNull() & p.isNotNull()).groupBy(*cols(keys)).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
        (F.avg(F.abs(e / F.nullif(y, F.lit(0.0)))) * 100).alias("mape"), corr(y, p).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return g.withColumn("p_value", t_two_sided(t, (F.col("n") - 2).cast("double")))


def sequences(df: DataFrame, columns: Sequence[str], length: int, keys, order="ts", chunk="1 day") -> DataFrame:
    """The last ``length`` rows as an array of value vectors; rows without a full history are left out."""
    def build(w):
        return {"sequence": F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w.rowsBetween(-length + 1, 0))}

    return row_frames(df, keys, order, length - 1, 0, build, chunk=chunk).where(F.size("sequence") == length)
