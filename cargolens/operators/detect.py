"""Detectors: Z-score and quartile flags of shipments, and lane-week trends.

Statistics are one row per lane and mode, so shipments meet them by a broadcast whose size is counted and are not
shuffled for the join. Quartiles are exact and need bounded memory (see ``percentiles``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.measures import cost_per_lb, percentiles, sized, week_start
from cargolens.schemas import DEVIATION, IQR_FACTOR, MIN_GROUP, MIN_WEEKLY, PRIOR_WEEKS, Z_THRESHOLD

KEYS = ["lane_id", "mode"]


def _flag(kind: str, z) -> list:
    return [
        F.concat(F.lit(f"{kind}_"), "shipment_id").alias("flag_id"),
        "shipment_id",
        F.lit(kind).alias("flag_type"),
        "lane_id",
        "mode",
        F.col("origin_city").alias("region"),
        F.col("total_cost").alias("cost_value"),
        z.cast("double").alias("z_score"),
        F.col("ship_date").alias("flag_date"),
    ]


def zscore_flags(ships: DataFrame, threshold: float = Z_THRESHOLD, min_group: int = MIN_GROUP) -> DataFrame:
    """Shipments whose cost per pound lies more than ``threshold`` sample deviations from the mean of lane and mode."""
    stats = ships.groupBy(*KEYS).agg(F.avg(cost_per_lb()).alias("mean_cpl"), F.stddev_samp(cost_per_lb()).alias("std_cpl"), F.count("*").alias("n")).where(F.col("n") >= min_group)
    z = (cost_per_lb() - F.col("mean_cpl")) / F.nullif(F.col("std_cpl"), F.lit(0.0))
    return ships.join(sized(stats), KEYS).withColumn("z", z).where(F.abs("z") > threshold).select(_flag("ZSCORE", F.col("z")))


def iqr_flags(ships: DataFrame, factor: float = IQR_FACTOR, min_group: int = MIN_GROUP) -> DataFrame:
    """Shipments whose cost per pound lies outside the quartile fences of lane and mode."""
    costed = ships.withColumn("cpl", cost_per_lb())
    return costed.join(sized(_fences(costed, factor, min_group)), KEYS).where("cpl > upper_fence or cpl < lower_fence").select(_flag("IQR", F.lit(None)))


def _fences(costed: DataFrame, factor: float, min_group: int) -> DataFrame:
    groups = costed.groupBy(*KEYS).agg(F.count("*").alias("rows")).where(F.col("rows") >= min_group)
    spread = factor * (F.col("q3") - F.col("q1"))
    fences = percentiles(costed, KEYS, "cpl", {"q1": 0.25, "q3": 0.75}).join(groups, KEYS)
    return fences.select(*KEYS, (F.col("q1") - spread).alias("lower_fence"), (F.col("q3") + spread).alias("upper_fence"))


def marked(ships: DataFrame, threshold: float = Z_THRESHOLD, factor: float = IQR_FACTOR, min_group: int = MIN_GROUP) -> DataFrame:
    """``ships`` with z_flag, iqr_flag and is_anomaly_flag (either), 0 or 1: what the two detectors flag, in place.

    One join with the statistics of lane and mode; shipments are not shuffled, unlike by a join with their flags on
    shipment_id, which is their key.
    """
    costed = ships.withColumn("cpl", cost_per_lb())
    stats = costed.groupBy(*KEYS).agg(F.avg("cpl").alias("m"), F.stddev_samp("cpl").alias("d"), F.count("*").alias("n")).where(F.col("n") >= min_group).drop("n")
    both = sized(stats.join(_fences(costed, factor, min_group), KEYS))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    z = F.abs((F.col("cpl") - F.col("m")) / F.nullif(F.col("d"), F.lit(0.0))) > threshold
    out = costed.join(both, KEYS, "left").withColumns({"z_flag": flag(z), "iqr_flag": flag(F.expr("cpl > upper_fence or cpl < lower_fence"))})
    return out.select(*ships.columns, "z_flag", "iqr_flag", F.greatest("z_flag", "iqr_flag").alias("is_anomaly_flag"))


def anomaly_flags(ships: DataFrame) -> DataFrame:
    return zscore_flags(ships).unionByName(iqr_flags(ships))


def lane_week_trends(ships: DataFrame, min_weekly: int = MIN_WEEKLY, prior: int = PRIOR_WEEKS, deviation: float = DEVIATION) -> DataFrame:
    """Weeks of at least ``min_weekly`` shipments against the mean of up to four observed weeks before; one window pass."""
    weekly = (
        ships.groupBy(week_start(F.col("ship_date")).alias("week_start"), *KEYS)
        .agg(F.count("*").alias("shipment_count"), F.avg(cost_per_lb()).alias("avg_cost_per_lb"))
        .where(F.col("shipment_count") >= min_weekly)
    )
    w = Window.partitionBy(*KEYS).orderBy("week_start")
    rolled = weekly.withColumn("rolling_4wk_avg", F.avg("avg_cost_per_lb").over(w.rowsBetween(-4, -1))).withColumn("prior_weeks", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    off = (F.col("avg_cost_per_lb") - F.col("rolling_4wk_avg")) / F.nullif(F.col("rolling_4wk_avg"), F.lit(0.0))
    return rolled.withColumn("pct_deviation", off).select(
        "week_start", *KEYS, "shipment_count", "avg_cost_per_lb", "rolling_4wk_avg", "pct_deviation",
        F.when((F.col("prior_weeks") >= prior) & (F.abs("pct_deviation") > deviation), 1).otherwise(0).alias("is_anomalous"),
    )


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("flag_type").agg(F.count("*").alias("flags"))


def flagged_distinct(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count_distinct("shipment_id").alias("unique_flagged_shipments"))


def trend_summary(trends: DataFrame) -> DataFrame:
    return trends.agg(F.count("*").alias("trend_rows"), F.sum("is_anomalous").alias("anomalous_weeks"))
