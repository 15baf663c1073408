"""Checks of loaded tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import ratio
from cargolens.schemas import EXPECTED_ROWS

CHECKED = ("shipment_id", "ship_date", "mode", "carrier_id", "total_cost", "run_id")


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """table_name, n_rows, expected, status for each table; tables without a floor expect one row."""
    expected = EXPECTED_ROWS if expected is None else expected
    one = lambda name, df: df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(expected.get(name, 1)).cast("long").alias("expected"))
    counts = reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])
    return counts.withColumn("status", F.when(F.col("n_rows") >= F.col("expected"), "OK").otherwise("WARN"))


def null_counts(ships: DataFrame, columns: tuple[str, ...] = CHECKED) -> DataFrame:
    """column_name, nulls, status; one pass."""
    counts = ships.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "nulls").withColumn("status", F.when(F.col("nulls") == 0, "OK").otherwise("WARN"))


def flag_rate(ships: DataFrame, flags: DataFrame) -> DataFrame:
    """Share of shipments with a flag, expected within 5 and 20 percent."""
    joined = ships.join(flags.select("shipment_id", F.col("shipment_id").alias("flagged_id")).distinct(), "shipment_id", "left")
    rate = joined.agg(ratio(F.count_distinct("flagged_id"), F.count_distinct("shipment_id")).alias("flag_rate"))
    return rate.withColumn("status", F.when(F.col("flag_rate").between(0.05, 0.20), "OK").otherwise("WARN"))


def ontime_by_mode(ships: DataFrame) -> DataFrame:
    return ships.groupBy("mode").agg(ratio(F.sum("on_time_flag"), F.count("*")).alias("on_time_rate")).orderBy("mode")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def join_coverage(ships: DataFrame, rates: DataFrame) -> DataFrame:
    """Shipments without a rate of their carrier, mode and lane."""
    keys = ["carrier_id", "mode", "lane_id"]
    missing = ships.select(*keys).distinct().join(rates.select(*keys).distinct(), keys, "left_anti")
    return missing.agg(F.count("*").alias("missing_keys"))


def base_cost_error(ships: DataFrame) -> DataFrame:
    """The greatest distance of base_cost from rate times weight, with a floor of 1."""
    due = F.round(F.greatest(F.lit(1.0), F.col("base_rate_per_cwt") * F.col("weight_lbs") / 100), 2)
    return ships.agg(F.max(F.abs(F.col("base_cost") - due)).alias("max_error"), F.count("*").alias("n_rows"))
