"""Shipments, truth, fuel and rates from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions.measures import sized

LANE, NATION_LANE = "lane_id", "nation_lane"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str, lane: str = LANE) -> DataFrame:
    """One row per line item. ``lane``: by region (25 lanes) or by nation (625).

    Nations, regions and suppliers are broadcast where their counted size allows it; orders and customers are joined
    by shuffle where they are large.
    """
    t = lambda name: table(spark, sf_dir, name)
    places = sized(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    origin = places.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("o_nation"), F.col("r_name").alias("o_region"))
    dest = places.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("d_nation"), F.col("r_name").alias("d_region"))
    buyers = t("customer").select("c_custkey", "c_nationkey").join(dest, "c_nationkey")
    placed = t("orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "d_nation", "d_region")
    sellers = sized(t("supplier").select("s_suppkey", "s_name", "s_nationkey").join(origin, "s_nationkey"))
    rows = t("lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    day = F.col("l_shipdate").cast("date")
    anomaly = ((F.col("l_orderkey") + F.col("l_partkey")) % 14 == 0).cast("int")
    lane_id = F.concat_ws("-", "o_region", "d_region") if lane == LANE else F.concat_ws("-", "o_nation", "d_nation")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", day).alias("shipment_id"),
        day.alias("ship_date"),
        F.concat_ws(",", "o_nation", "o_region").alias("origin_city"),
        F.concat_ws(",", "d_nation", "d_region").alias("dest_city"),
        F.when(F.col("l_returnflag") == "A", "PARCEL").when(F.col("l_returnflag") == "N", "LTL").otherwise("FTL").alias("mode"),
        F.col("s_name").alias("carrier_id"),
        F.col("l_quantity").alias("weight_lbs"),
        (F.col("l_extendedprice") / (F.col("l_quantity") / 100)).alias("base_rate_per_cwt"),
        F.col("l_extendedprice").alias("base_cost"),
        F.col("l_tax").alias("fuel_surcharge_pct"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax")) * F.when(anomaly == 1, 2.5 + 2.5 * (F.col("l_partkey") % 100) / 100).otherwise(1.0)).alias("total_cost"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("on_time_flag"),
        lane_id.alias("lane_id"),
        F.lit("run-1").alias("run_id"),
        anomaly.alias("is_anomaly"),
    )


def truth(ships: DataFrame) -> DataFrame:
    return ships.select("shipment_id", "is_anomaly")


def fuel(spark: SparkSession) -> DataFrame:
    """The price formula on the Mondays of the test data, by week number modulo 130."""
    from cargolens.operators.generate import fuel_price  # which imports this package

    weeks = spark.sql("select explode(sequence(date'1995-01-02', date'2001-10-29', interval 7 days)) as week_start")
    price = fuel_price(F.expr("cast(datediff(week_start, date'1995-01-02') div 7 as int)") % 130)
    return weeks.select("week_start", F.round(price, 4).alias("fuel_price_per_gallon"), F.round((price - 2.5) / 2.5 * 0.30, 4).alias("surcharge_pct"))


def rates(ships: DataFrame) -> DataFrame:
    return ships.groupBy("carrier_id", "mode", "lane_id").agg(F.avg("base_rate_per_cwt").alias("base_rate_per_cwt"), F.min("ship_date").alias("effective_date"))
