"""Feature selection.

Choosing columns changes the schema, so these functions read one small result
(at most columns x columns numbers) on the driver before building the output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import attach_row
from .agg import corr_matrix
from .clean import column_coverage
from .features import column_medians


def column_dispersion(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample variance, mean and variance over mean per column, one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.var_samp(c).alias("variance"), F.avg(c).alias("mean"),
                      F.try_divide(F.var_samp(c), F.abs(F.avg(c))).alias("dispersion")) for c in columns]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def drop_low(df: DataFrame, columns: Sequence[str], by: str = "variance", threshold: float = 0.0) -> DataFrame:
    """Drop columns whose variance (or dispersion) does not exceed the threshold."""
    low = [r["column"] for r in column_dispersion(df, columns).collect() if r[by] is None or r[by] <= threshold]
    return df.drop(*low)


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.95, rule: str = "later") -> list[str]:
    """Columns to drop so that no kept pair correlates above the threshold.

    ``later`` drops the later column of a pair, ``variance`` the one with the lower
    variance, ``mean_corr`` the one with the higher mean absolute correlation.
    """
    pairs = [(r["a"], r["b"], abs(r["corr"])) for r in corr_matrix(df, columns).collect() if r["corr"] is not None]
    if rule == "later":
        rank = {c: i for i, c in enumerate(columns)}
    elif rule == "variance":
        rank = {r["column"]: -(r["variance"] or 0.0) for r in column_dispersion(df, columns).collect()}
    elif rule == "mean_corr":
        rank = {c: sum(r for a, b, r in pairs if c in (a, b)) / max(len(columns) - 1, 1) for c in columns}
    else:
        raise ValueError(f"unknown rule {rule}")
    gone: list[str] = []
    for a, b, r in sorted(pairs, key=lambda p: (columns.index(p[0]), columns.index(p[1]))):
        if r > threshold and a not in gone and b not in gone:
            gone.append(a if rank[a] > rank[b] else b)
    return gone


def drop_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.95, rule: str = "later") -> DataFrame:
    return df.drop(*correlated_columns(df, columns, threshold, rule))


def select_fdr(df: DataFrame, features: Sequence[str], target: str, fdr: float = 0.05) -> list[str]:
    """Columns with a significant linear relation to the target under a false-discovery bound (F-test)."""
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler

    vec = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip").transform(df)
    chooser = (UnivariateFeatureSelector(featuresCol="_f", labelCol=target, outputCol="_s", selectionMode="fdr")
               .setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(fdr))
    return [features[i] for i in chooser.fit(vec).selectedFeatures]


def complete_and_fill(df: DataFrame, columns: Sequence[str], minimum: float) -> DataFrame:
    """Keep columns complete enough and fill what is missing with their median."""
    found = {r["column"]: r["coverage"] for r in column_coverage(df, columns).collect()}
    good = [c for c in columns if found[c] >= minimum]
    rest = [c for c in df.columns if c not in columns]
    med = column_medians(df, good)
    return attach_row(df, med).select(*rest, *[F.coalesce(F.col(c).cast("double"), F.col(f"{c}_med")).alias(c) for c in good])
