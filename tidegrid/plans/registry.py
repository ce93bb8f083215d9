"""Registry of queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready
from .views import CTES, Views

Build = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Query:
    ids: str
    name: str
    build: Build
    sql: str | None
    rounded: tuple[str, ...]
    whole: tuple[str, ...]
    splits: bool  # whether it asks which keys are too large for one task


REGISTRY: dict[str, Query] = {}

# Added before rounding so that exact halves and minus zero round alike whatever
# the order of summation was.
NUDGE = 1.2345678e-8


def query(ids: str, name: str, *, views: str = "", sql: str | None = None,
          r: str = "", i: str = "", digits: int = 6):
    """Register ``build(views) -> DataFrame`` under ``name``.

    ``r`` lists doubles rounded to ``digits`` and ``i`` integers widened to
    64 bit, in both engines; ``views`` names the shared views the SQL reads.
    """
    rounded, whole = tuple(r.split()), tuple(i.split())

    def register(build: Build) -> Build:
        def tidy(v: Views) -> DataFrame:
            df = build(v)
            made = {c: F.round(F.col(c).cast("double") + F.lit(NUDGE), digits) + F.lit(0.0) for c in rounded}
            made.update({c: F.col(c).cast("long") for c in whole})
            return df.withColumns(made) if made else df

        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        source = inspect.getsource(build)
        REGISTRY[name] = Query(ids, name, tidy, _oracle(sql, views, rounded, whole, digits), rounded, whole, "v.split(" in source or "v.spread(" in source)
        return build

    return register


def _oracle(sql, views, rounded, whole, digits):
    if sql is None:
        return None
    body = sql.strip().rstrip(";")
    recursive = " FROM r JOIN " in sql or body.startswith("WITH RECURSIVE ")
    body = body.removeprefix("WITH RECURSIVE ") if recursive else body
    body = f"WITH {body}" if recursive and not body.startswith("WITH ") else body
    chain = CTES(views.split())
    if chain:
        joined = ",\n".join(chain)
        if body[:5].upper() == "WITH ":
            body = f"WITH {"RECURSIVE " if recursive else ""}{joined},\n{body[5:]}"
        else:
            body = f"WITH {joined}\n{body}"
    fixes = [f"round(CAST({c} AS DOUBLE) + {NUDGE!r}::DOUBLE, {digits}) + 0 AS {c}" for c in rounded]
    fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in whole]
    return f"SELECT * REPLACE ({', '.join(fixes)}) FROM (\n{body}\n) AS checked" if fixes else body


def load() -> dict[str, Query]:
    """Import every catalog module once."""
    from . import catalog  # noqa: F401  (registers on import)

    return REGISTRY


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries; those that can split large keys a second time, as ``<name>_split``, with every key split."""
    def bind(q: Query, **options):
        return lambda spark, sf_dir: q.build(Views(ready(spark), sf_dir, **options))

    out = {n: bind(q) for n, q in load().items()}
    return out | {f"{n}_split": bind(q, limit=0) for n, q in load().items() if q.sql and q.splits}


def oracles() -> dict[str, str]:
    out = {n: q.sql for n, q in load().items() if q.sql}
    return out | {f"{n}_split": out[n] for n, q in load().items() if q.sql and q.splits}
