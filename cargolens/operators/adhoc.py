"""Ad-hoc queries. Top-k results have a total order, so that ties do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import month_start, ratio, week_start


def _per_lb():
    """Unprotected, as defined: a weight of zero is an error in ANSI mode."""
    return F.col("total_cost") / F.col("weight_lbs")


def top_expensive_lanes(ships: DataFrame, min_count: int = 20, k: int = 10) -> DataFrame:
    return (
        ships.groupBy("lane_id", "mode")
        .agg(F.count("*").alias("shipments"), F.round(F.avg(_per_lb()), 4).alias("avg_cost_per_lb"), F.round(F.avg("total_cost"), 2).alias("avg_total_cost"))
        .where(F.col("shipments") >= min_count)
        .orderBy(F.desc("avg_cost_per_lb"), "lane_id", "mode")
        .limit(k)
    )


def top_carrier_anomaly(ships: DataFrame, flags: DataFrame, min_count: int = 100, k: int = 10) -> DataFrame:
    """Counts rows of the join: shipments with both flags count twice."""
    joined = ships.join(flags.select("shipment_id", F.col("shipment_id").alias("flagged_id")), "shipment_id", "left")
    return (
        joined.groupBy("carrier_id", "mode")
        .agg(F.count("*").alias("total_shipments"), F.count_distinct("flagged_id").alias("flagged"), F.round(F.avg("total_cost"), 2).alias("avg_cost"))
        .where(F.col("total_shipments") >= min_count)
        .select("carrier_id", "mode", "total_shipments", "flagged", F.round(ratio(F.col("flagged"), F.col("total_shipments")), 4).alias("anomaly_rate"), "avg_cost")
        .orderBy(F.desc("anomaly_rate"), "carrier_id", "mode")
        .limit(k)
    )


def monthly_cost_trend(ships: DataFrame) -> DataFrame:
    return (
        ships.groupBy(month_start(F.col("ship_date")).alias("month"), "mode")
        .agg(F.count("*").alias("shipments"), F.round(F.avg("total_cost"), 2).alias("avg_cost"), F.round(F.avg(_per_lb()), 4).alias("avg_cpl"))
        .orderBy("month", "mode")
    )


def fuel_vs_cost(fuel: DataFrame, ships: DataFrame) -> DataFrame:
    """Shipments are summed up by week before the join; weeks without any stay with a count of 0."""
    weekly = ships.groupBy(week_start(F.col("ship_date")).alias("week_start")).agg(F.count("shipment_id").alias("n"), F.sum("total_cost").alias("s"), F.count("total_cost").alias("c"))
    return (
        fuel.join(weekly, "week_start", "left")
        .groupBy("week_start", "fuel_price_per_gallon", "surcharge_pct")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shipments"), F.round(F.sum("s") / F.nullif(F.sum("c"), F.lit(0)), 2).alias("avg_cost"))
        .orderBy("week_start")
    )


def flag_detail(flags: DataFrame, ships: DataFrame, k: int = 50) -> DataFrame:
    """The first k flags by type, then score, with their shipments."""
    joined = flags.select("flag_type", "lane_id", "mode", "z_score", "shipment_id").join(ships.select("shipment_id", "ship_date", "carrier_id", "total_cost", "weight_lbs"), "shipment_id")
    return (
        joined.orderBy("flag_type", F.desc_nulls_last("z_score"), "shipment_id")
        .limit(k)
        .select("flag_type", "lane_id", "mode", "z_score", "ship_date", "carrier_id", "total_cost", "weight_lbs", F.round(_per_lb(), 4).alias("cost_per_lb"), "shipment_id")
    )
