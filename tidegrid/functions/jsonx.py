"""Dynamic attributes: JSON text and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import col


def field(json, key: str, dtype: str = "double") -> Column:
    """One JSON field, NULL when absent or of another type."""
    return F.get_json_object(col(json), f"$.{key}").try_cast(dtype)


def as_map(json) -> Column:
    return F.from_json(col(json), "map<string,double>")


def explode_fields(df: DataFrame, json: str, keys: Sequence[str]) -> DataFrame:
    """One row per key of the JSON object."""
    return df.select(*keys, F.explode(as_map(json)).alias("name", "number"))


def collect_fields(df: DataFrame, keys: Sequence[str], name: str, number: str) -> DataFrame:
    """Back to one map per key; one value per name is kept (the largest)."""
    once = df.groupBy(*keys, name).agg(F.max(number).alias(number))
    return once.groupBy(*keys).agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct(name, number)))).alias("features"))


def split_core(features, core: Sequence[str]) -> dict[str, Column]:
    """Core fields as columns, the rest as JSON text."""
    m = col(features)
    out = {c: m[c] for c in core}
    out["extended"] = F.to_json(F.map_filter(m, lambda k, _: ~k.isin(*core)))
    return out


def flatten_maps(groups: Sequence[str]) -> Column:
    """Several feature maps as one, names prefixed by their group."""
    def prefixed(g):
        return F.transform_keys(F.col(g), lambda k, _: F.concat(F.lit(f"{g}_"), k))

    return F.map_concat(*[prefixed(g) for g in groups])


def key_universe(df: DataFrame, json: str) -> DataFrame:
    """Distinct keys over all rows."""
    return df.select(F.explode(F.json_object_keys(col(json))).alias("name")).distinct()
