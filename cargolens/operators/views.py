"""The six views, from detector flags, and the export variants, from labelled truth.

A shipment with both flags is two rows of a join with the flags. The carrier scorecard counts such rows twice, as it
is defined; the other views count shipments once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import cost_per_lb, least_or_null, month_start, origin_state, percentiles, ratio
from cargolens.schemas import MIN_LANE, OVERRUN_CAP, RISK_WEIGHTS


def _month():
    return month_start(F.col("ship_date")).alias("month")


def _marked(ships: DataFrame, ids: DataFrame) -> DataFrame:
    """is_anomaly_flag 0 or 1 per shipment."""
    marks = ids.select("shipment_id").distinct().withColumn("__m", F.lit(1))
    return ships.join(marks, "shipment_id", "left").withColumn("is_anomaly_flag", F.coalesce("__m", F.lit(0))).drop("__m")


def labelled(ships: DataFrame, truth: DataFrame) -> DataFrame:
    """Export input: flags are the labelled truth; the state is what follows the first comma, null without one."""
    return _marked(ships, truth.where("is_anomaly = 1")).withColumn("origin_state", origin_state(strict=True)).withColumn("month", _month())


def carrier_ontime(ships: DataFrame) -> DataFrame:
    return ships.groupBy("carrier_id", "mode", _month()).agg(
        F.count("*").alias("total_shipments"), F.sum("on_time_flag").alias("on_time_shipments"), ratio(F.sum("on_time_flag"), F.count("*")).alias("on_time_rate")
    )


def cost_by_mode_region(ships: DataFrame) -> DataFrame:
    keys = ["mode", "origin_state", "month"]
    placed = ships.select("mode", origin_state().alias("origin_state"), _month(), "total_cost", cost_per_lb().alias("cpl"))
    sums = placed.groupBy(*keys).agg(
        F.count("*").alias("shipment_count"), F.avg("total_cost").alias("avg_total_cost"), F.avg("cpl").alias("avg_cost_per_lb"), F.sum("total_cost").alias("total_spend")
    )
    medians = percentiles(placed, keys, "total_cost", {"median_total_cost": 0.5}).drop("n")
    on = F.lit(True)
    for k in keys:
        on &= sums[k].eqNullSafe(medians[k])
    return sums.join(medians, on, "left").select(*[sums[k] for k in keys], "shipment_count", "avg_total_cost", "avg_cost_per_lb", "median_total_cost", "total_spend")


def anomaly_rate_by_region(ships: DataFrame, flags: DataFrame) -> DataFrame:
    """Flags are brought down to one per shipment before the join."""
    return (
        _marked(ships, flags)
        .groupBy(origin_state().alias("origin_state"), "mode", _month())
        .agg(F.count_distinct("shipment_id").alias("total_shipments"), F.count_distinct(F.when(F.col("is_anomaly_flag") == 1, F.col("shipment_id"))).alias("flagged_shipments"))
        .withColumn("anomaly_rate", ratio(F.col("flagged_shipments"), F.col("total_shipments")))
    )


def anomaly_rate_of(marked: DataFrame) -> DataFrame:
    """The same of shipments with is_anomaly_flag, whose key is shipment_id."""
    counts = marked.groupBy(origin_state().alias("origin_state"), "mode", _month()).agg(F.count("*").alias("total_shipments"), F.sum("is_anomaly_flag").alias("flagged_shipments"))
    return counts.withColumn("anomaly_rate", ratio(F.col("flagged_shipments"), F.col("total_shipments")))


def carrier_scorecard_of(marked: DataFrame) -> DataFrame:
    """``carrier_scorecard`` of shipments with z_flag and iqr_flag: a shipment with both counts as two rows."""
    rows = F.greatest(F.col("z_flag") + F.col("iqr_flag"), F.lit(1))
    mean = lambda c: F.sum(c * rows) / F.nullif(F.sum(F.when(c.isNotNull(), rows)).cast("double"), F.lit(0.0))
    n, cost = F.sum(rows), F.col("total_cost")
    return marked.groupBy("carrier_id", "mode").agg(
        n.alias("total_shipments"), ratio(F.sum(F.col("on_time_flag") * rows), n).alias("on_time_rate"), mean(cost).alias("avg_cost"), mean(cost_per_lb()).alias("avg_cost_per_lb"),
        ratio(F.sum("is_anomaly_flag"), n).alias("anomaly_rate"), F.sum(cost * rows).alias("total_spend"),
    )


def carrier_scorecard(ships: DataFrame, flags: DataFrame) -> DataFrame:
    joined = ships.join(flags.select("shipment_id", F.col("shipment_id").alias("flagged_id")), "shipment_id", "left")
    n = F.count("*")
    return joined.groupBy("carrier_id", "mode").agg(
        n.alias("total_shipments"),
        ratio(F.sum("on_time_flag"), n).alias("on_time_rate"),
        F.avg("total_cost").alias("avg_cost"),
        F.avg(cost_per_lb()).alias("avg_cost_per_lb"),
        ratio(F.count_distinct("flagged_id"), n).alias("anomaly_rate"),
        F.sum("total_cost").alias("total_spend"),
    )


def executive_summary(ships: DataFrame, flags: DataFrame) -> DataFrame:
    """One row, also for no shipments; both sides of the cross join have one row."""
    flagged = flags.agg(F.count_distinct("shipment_id").alias("total_anomalies_flagged"))
    totals = ships.agg(
        F.count("*").alias("total_shipments"), F.sum("total_cost").alias("total_freight_spend"), F.avg("total_cost").alias("avg_cost_per_shipment"),
        ratio(F.sum("on_time_flag"), F.count("*")).alias("overall_on_time_rate"), F.min("ship_date").alias("data_start_date"), F.max("ship_date").alias("data_end_date"),
    )
    return totals.crossJoin(flagged).select(
        "total_shipments", "total_freight_spend", "avg_cost_per_shipment", "overall_on_time_rate", "total_anomalies_flagged",
        ratio(F.col("total_anomalies_flagged"), F.col("total_shipments")).alias("overall_anomaly_rate"), "data_start_date", "data_end_date",
    )


def executive_summary_of(marked: DataFrame) -> DataFrame:
    """``executive_summary`` of shipments with is_anomaly_flag, whose key is shipment_id."""
    n, flagged = F.count("*"), F.coalesce(F.sum("is_anomaly_flag"), F.lit(0))
    return marked.agg(
        n.alias("total_shipments"), F.sum("total_cost").alias("total_freight_spend"), F.avg("total_cost").alias("avg_cost_per_shipment"), ratio(F.sum("on_time_flag"), n).alias("overall_on_time_rate"),
        flagged.alias("total_anomalies_flagged"), ratio(flagged, n).alias("overall_anomaly_rate"), F.min("ship_date").alias("data_start_date"), F.max("ship_date").alias("data_end_date"),
    )


def lane_risk_of(marked: DataFrame, min_lane: int = MIN_LANE) -> DataFrame:
    """``lane_risk`` of shipments with is_anomaly_flag."""
    return _risk(marked, min_lane).orderBy(F.desc_nulls_last("risk_score"), "lane_id")


def _risk(marked: DataFrame, min_lane: int) -> DataFrame:
    flag, late = F.col("is_anomaly_flag"), F.when(F.col("on_time_flag") == 0, 1).otherwise(0)
    lanes = (
        marked.groupBy("lane_id")
        .agg(
            F.count("*").alias("total_shipments"), F.sum(flag).alias("anomaly_count"), F.sum(late).alias("late_count"),
            F.avg(F.when(flag == 0, F.col("total_cost"))).alias("normal"), F.avg(F.when(flag == 1, F.col("total_cost"))).alias("anomalous"),
        )
        .where(F.col("total_shipments") >= min_lane)
        .withColumn("anomaly_rate", ratio(F.col("anomaly_count"), F.col("total_shipments")))
        .withColumn("late_rate", ratio(F.col("late_count"), F.col("total_shipments")))
        .withColumn("overrun", (F.col("anomalous") - F.col("normal")) / F.nullif(F.col("normal"), F.lit(0.0)))
    )
    a, b, c = RISK_WEIGHTS
    score = a * F.col("anomaly_rate") + b * F.col("late_rate") + c * least_or_null(F.col("overrun"), OVERRUN_CAP) / OVERRUN_CAP
    return lanes.select(
        "lane_id", "total_shipments", "anomaly_count", F.round(F.col("anomaly_rate") * 100, 2).alias("anomaly_rate_pct"), "late_count",
        F.round(F.col("late_rate") * 100, 2).alias("late_rate_pct"), F.round("normal", 2).alias("avg_normal_cost"), F.round("anomalous", 2).alias("avg_anomalous_cost"),
        F.round(F.col("overrun") * 100, 1).alias("cost_overrun_pct"), F.round(score, 4).alias("risk_score"),
    )


def lane_risk(ships: DataFrame, flags: DataFrame, min_lane: int = MIN_LANE) -> DataFrame:
    """Risk by lane, greatest first, lanes without a score last. A lane without a flag has no overrun and no score."""
    return _risk(_marked(ships, flags), min_lane).orderBy(F.desc_nulls_last("risk_score"), "lane_id")


def anomaly_rate_export(marked: DataFrame) -> DataFrame:
    return (
        marked.where("origin_state is not null and mode is not null and month is not null")
        .groupBy("origin_state", "mode", "month")
        .agg(F.count_distinct("shipment_id").alias("total_shipments"), F.sum("is_anomaly_flag").alias("flagged_shipments"))
        .withColumn("anomaly_rate", ratio(F.col("flagged_shipments"), F.col("total_shipments")))
    )


def carrier_scorecard_export(marked: DataFrame) -> DataFrame:
    return marked.where("carrier_id is not null and mode is not null").groupBy("carrier_id", "mode").agg(
        F.count("*").alias("total_shipments"), F.avg("on_time_flag").alias("on_time_rate"), F.avg("total_cost").alias("avg_cost"), F.avg(cost_per_lb()).alias("avg_cost_per_lb"),
        F.avg("is_anomaly_flag").alias("anomaly_rate"), F.sum("total_cost").alias("total_spend"),
    )


def lane_risk_export(marked: DataFrame, min_lane: int = MIN_LANE) -> DataFrame:
    return _risk(marked.where("lane_id is not null"), min_lane).orderBy(F.desc_nulls_last("risk_score"), "lane_id")


def export_frames(ships: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """The six exports by file name, in the order of their keys."""
    marked, injected = labelled(ships, truth), truth.where("is_anomaly = 1")
    keyed = lambda *keys: ships.dropna(subset=list(keys))
    return {
        "vw_carrier_ontime": carrier_ontime(keyed("carrier_id", "mode")).orderBy("carrier_id", "mode", "month"),
        "vw_cost_by_mode_region": cost_by_mode_region(keyed("mode").where(origin_state(strict=True).isNotNull())).orderBy("mode", "origin_state", "month"),
        "vw_anomaly_rate_by_region": anomaly_rate_export(marked).orderBy("origin_state", "mode", "month"),
        "vw_carrier_scorecard": carrier_scorecard_export(marked).orderBy("carrier_id", "mode"),
        "vw_executive_summary": executive_summary(ships, injected),
        "vw_lane_risk": lane_risk_export(marked),
    }
