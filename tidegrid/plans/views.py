"""The driver tables seen as sensor series, in Spark and as SQL text.

Every view reads a whole table; none fixes a subset of keys or rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import Split, bucket, cols, split_hot
from ..sources.tables import stage

SIGNALS = ("click", "error", "purchase", "signup", "view")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str, limit: int = 2_000_000):
        """``limit``: rows from which a key is split; 0 splits every key."""
        self.spark, self.dir, self.limit = spark, sf_dir, limit
        self.asked = False  # whether a query has asked for a split

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def split(self, *keys: str, of: str = "readings") -> Split:
        """Keys of a view too large for one task, measured once per query."""
        self.asked = True
        made = self.__dict__.setdefault("_splits", {})
        if (of, keys) not in made:
            made[of, keys] = split_hot(getattr(self, of), cols(keys), self.limit)
        return made[of, keys]

    def written(self, name: str, *columns: str) -> DataFrame:
        """Columns of a view that a query reads many times: computed once, then read from a table, by ``split`` too."""
        self.__dict__[name] = stage(getattr(self, name).select(*columns), name)
        return self.__dict__[name]

    def spread(self, of: str):
        """For quantiles over a whole view: spread them unless it is small."""
        return None if not self.split(of=of).found else "spread"

    @cached_property
    def readings(self) -> DataFrame:
        """Long form, one row per reading."""
        return self.table("events").select(
            F.col("user_id").alias("entity"), F.col("event_type").alias("signal"),
            "ts", "value", "event_id", "props")

    @cached_property
    def readings_n(self) -> DataFrame:
        """Readings with gaps (NULL) and a -1 sentinel."""
        e = F.col("event_id")
        return self.readings.withColumn(
            "value", F.when(e % 7 == 0, None).when(e % 11 == 0, -1.0).otherwise(F.col("value")))

    @cached_property
    def wide(self) -> DataFrame:
        """One row per entity and hour, one column per signal (mean, NULL if absent)."""
        return (self.readings.groupBy("entity", bucket("ts", "1h").alias("hour"))
                .agg(*[F.avg(F.when(F.col("signal") == s, F.col("value"))).alias(s) for s in SIGNALS]))

    @cached_property
    def grid(self) -> DataFrame:
        """Hourly mean per signal over all entities; hours without readings are absent."""
        return (self.readings.groupBy("signal", bucket("ts", "1h").alias("ts"))
                .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")))

    @cached_property
    def price(self) -> DataFrame:
        """Hourly external price series."""
        return (self.readings.where("signal = 'purchase'")
                .groupBy(bucket("ts", "1h").alias("hour")).agg(F.avg("value").alias("price")))

    @cached_property
    def lines(self) -> DataFrame:
        """Row-level climate readings: temperature, humidity, light, CO2, power, price."""
        q = F.col("l_quantity")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("ts"),
            F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"),
            q.alias("temp"), (40 + 500 * F.col("l_discount")).alias("rh"),
            (F.col("l_extendedprice") / 100).alias("light"),
            (400 + 10000 * F.col("l_tax")).alias("co2"), F.col("l_linestatus").alias("status"))

    @cached_property
    def climate(self) -> DataFrame:
        """Daily climate per entity: inside/outside temperature, humidity, light, CO2, power, price."""
        return (self.lines.groupBy("entity", "ts").agg(
            F.avg("temp").alias("temp"), (F.min("temp") / 2).alias("out_temp"),
            F.avg("rh").alias("rh"), F.avg("light").alias("light"), F.avg("co2").alias("co2"),
            F.sum("temp").alias("power"), F.avg(F.col("light") * 100 / F.col("temp")).alias("price"),
            F.avg("line").alias("wind"), F.count(F.lit(1)).alias("n")))

    @cached_property
    def price_daily(self) -> DataFrame:
        return (self.table("orders").groupBy(F.col("o_orderdate").alias("day"))
                .agg(F.avg("o_totalprice").alias("price")))

    @cached_property
    def solutions(self) -> DataFrame:
        """Candidate solutions: run, id, price (to minimise) and size (to maximise)."""
        return self.table("part").select(
            F.col("p_brand").alias("run"), F.col("p_partkey").alias("sol"),
            F.col("p_retailprice").alias("f1"), F.col("p_size").cast("double").alias("f2"),
            F.col("p_type").alias("algorithm"))


_SQL = {
    "readings": "SELECT user_id AS entity, event_type AS signal, ts, value, event_id, props FROM events",
    "readings_n": ("SELECT user_id AS entity, event_type AS signal, ts, CASE WHEN event_id % 7 = 0 THEN NULL "
                   "WHEN event_id % 11 = 0 THEN -1.0 ELSE value END AS value, event_id, props FROM events"),
    "wide": ("SELECT user_id AS entity, date_trunc('hour', ts)::TIMESTAMP AS hour, "
             + ", ".join(f"avg(value) FILTER (event_type = '{s}') AS {s}" for s in SIGNALS)
             + " FROM events GROUP BY ALL"),
    "grid": ("SELECT event_type AS signal, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS value, "
             "count(*) AS n FROM events GROUP BY ALL"),
    "price": ("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, avg(value) AS price FROM events "
              "WHERE event_type = 'purchase' GROUP BY ALL"),
    "lines": ("SELECT l_suppkey AS entity, l_shipdate AS ts, l_orderkey AS orderkey, l_linenumber AS line, "
              "l_quantity AS temp, 40 + 500 * l_discount AS rh, l_extendedprice / 100 AS light, "
              "400 + 10000 * l_tax AS co2, l_linestatus AS status FROM lineitem"),
    "climate": ("SELECT l_suppkey AS entity, l_shipdate AS ts, avg(l_quantity) AS temp, min(l_quantity) / 2 AS out_temp, "
                "avg(40 + 500 * l_discount) AS rh, avg(l_extendedprice / 100) AS light, "
                "avg(400 + 10000 * l_tax) AS co2, sum(l_quantity) AS power, "
                "avg(l_extendedprice / 100 * 100 / l_quantity) AS price, avg(l_linenumber) AS wind, count(*) AS n "
                "FROM lineitem GROUP BY ALL"),
    "price_daily": "SELECT o_orderdate AS day, avg(o_totalprice) AS price FROM orders GROUP BY ALL",
    "solutions": ("SELECT p_brand AS run, p_partkey AS sol, p_retailprice AS f1, p_size::DOUBLE AS f2, "
                  "p_type AS algorithm FROM part"),
}


def CTES(names: list[str]) -> list[str]:
    """``name AS (...)`` clauses for the named views."""
    return [f"{n} AS ({_SQL[n]})" for n in names]
