"""Data-quality checks, each a single pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failing_rows(df: DataFrame, checks: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per failed check of a row, from one scan. A check is true where the row fails."""
    hits = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])
    return df.select(*keep, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("check"))


def sensor_checks(time: str, rh: str, temp: str) -> dict[str, Column]:
    """Fixed physical limits of the integrity check."""
    return {"time_null": F.col(time).isNull(),
            "rh_range": ~F.col(rh).between(0, 105), "temp_range": ~F.col(temp).between(-50, 60)}


@dataclass(frozen=True)
class Expectation:
    kind: str  # not_null | between | mean_between | in_set
    column: str
    low: float | None = None
    high: float | None = None
    mostly: float = 1.0
    values: tuple = ()

    def share(self) -> Column:
        """Observed figure: a share of rows, or the mean."""
        c = F.col(self.column)
        if self.kind == "not_null":
            return F.count(c) / F.count(F.lit(1))
        if self.kind == "mean_between":
            return F.avg(c)
        ok = c.between(self.low, self.high) if self.kind == "between" else c.isin(*self.values)
        return F.coalesce(F.count_if(ok) / F.nullif(F.count(c), F.lit(0)), F.lit(1.0))

    def passed(self, seen: Column) -> Column:
        return F.coalesce(seen.between(self.low, self.high), F.lit(False)) if self.kind == "mean_between" else seen >= self.mostly


def run_suite(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """The whole suite in one aggregation; a missing column fails its expectations."""
    have = set(df.columns)
    parts = []
    for e in suite:
        seen = e.share().cast("double") if e.column in have else F.lit(None).cast("double")
        ok = e.passed(seen) if e.column in have else F.lit(False)
        parts.append(F.struct(F.lit(f"{e.kind}:{e.column}").alias("expectation"), seen.alias("observed"),
                              ok.alias("success")))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def stage_counts(df: DataFrame, days: str, distinct: Mapping[str, str]) -> DataFrame:
    """Rows, days, distinct values and time range of a stage."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.date_trunc("day", days)).alias("days"),
                  *[F.countDistinct(c).alias(n) for n, c in distinct.items()], F.min(days).alias("first_ts"),
                  F.max(days).alias("last_ts"))


def first_failure(df: DataFrame, checks: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """Any one failing row."""
    return failing_rows(df, checks, keep).limit(1)


def observed(df: DataFrame, name: str, metrics: Mapping[str, Column]):
    """Attach counters that ride along with the next action; returns the frame and the observation."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, *[c.alias(n) for n, c in metrics.items()]), o
