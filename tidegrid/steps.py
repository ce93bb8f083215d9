"""Operators as stages of a ``pyspark.ml`` pipeline, saved and loaded with it."""

from __future__ import annotations

import importlib
import json

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKAGE = __name__.rpartition(".")[0]
PLACES = ("operators.", "functions.", "sources.")


def _column(value):
    """Arguments that JSON cannot hold: {"expr": text} stands for a column."""
    if isinstance(value, dict):
        return F.expr(value["expr"]) if set(value) == {"expr"} else {k: _column(v) for k, v in value.items()}
    return [_column(v) for v in value] if isinstance(value, list) else value


class Step(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """One operator of this package, ``fn(df, **arguments)``, as a transformer.

    ``function`` names it by module and name inside the package (``operators.clean:clip_outliers``); ``arguments`` is a JSON object, in
    which ``{"expr": "value > 1"}`` stands for a column. ``keep`` lists the columns to go on with; none named means all.
    Both are readable and writable params, so a fitted pipeline of cleaning, window and scoring steps is one saved model. Only functions of
    this package's operators, functions and sources are called, whatever a loaded file says.
    """

    function = Param(Params._dummy(), "function", "module and name of the operator", typeConverter=TypeConverters.toString)
    arguments = Param(Params._dummy(), "arguments", "JSON object of its arguments", typeConverter=TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "columns of the result", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, function: str | None = None, arguments: str | dict | None = None, keep: list[str] | None = None):
        super().__init__()
        self._setDefault(arguments="{}", keep=[])
        given = {k: json.dumps(v) if k == "arguments" and not isinstance(v, str) else v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**given)

    def operator(self):
        place, _, name = self.getOrDefault(self.function).partition(":")
        if not place.startswith(PLACES) or name.startswith("_") or not name.isidentifier():
            raise ValueError(f"no operator of this package: {place}:{name}")
        module = importlib.import_module(f"{PACKAGE}.{place}")
        fn = getattr(module, name, None)
        if not callable(fn) or getattr(fn, "__module__", None) != module.__name__:
            raise ValueError(f"no operator of this package: {place}:{name}")
        return fn

    def _transform(self, dataset: DataFrame) -> DataFrame:
        arguments = {k: _column(v) for k, v in json.loads(self.getOrDefault(self.arguments)).items()}
        out, keep = self.operator()(dataset, **arguments), self.getOrDefault(self.keep)
        return out.select(*keep) if keep else out
