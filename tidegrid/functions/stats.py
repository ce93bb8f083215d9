"""Statistics safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .clean import col


def corr(x: str | Column, y: str | Column, over: WindowSpec | None = None, flat: float = 1e-9) -> Column:
    """Pearson correlation over rows where both are present; NULL when either is constant.

    The built-in divides by zero on constant input, which ANSI mode turns into a failed job.
    """
    x, y = col(x).cast("double"), col(y).cast("double")
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    wrap = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    spread = wrap(F.stddev_pop(a)) * wrap(F.stddev_pop(b))
    return F.when(spread > flat, wrap(F.covar_pop(a, b)) / spread)
