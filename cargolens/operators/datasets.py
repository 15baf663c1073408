"""The data behind dashboard and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.measures import cost_per_lb_floored, percentiles, week_end, week_start
from cargolens.operators.evaluate import local_marks
from cargolens.schemas import DEVIATION, PRIOR_WEEKS


def flagged(ships: DataFrame) -> DataFrame:
    """Shipments, whose key is shipment_id, with cpl and flagged 0 or 1 by either local method."""
    return local_marks(ships).withColumn("flagged", F.greatest("z", "q")).drop("z", "q")


def kpis(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count("*").alias("total_shipments"), F.avg("flagged").alias("anomaly_rate"), F.avg("cpl").alias("avg_cpl"), F.avg("on_time_flag").alias("on_time_rate"))


def lane_week_trends(ships: DataFrame) -> DataFrame:
    """All weeks; the rolling mean needs four measured weeks before, its floor as a divisor is 1e-6."""
    weekly = (
        ships.withColumn("cpl", cost_per_lb_floored())
        .where("ship_date is not null and lane_id is not null and mode is not null")
        .groupBy(week_start(F.col("ship_date")).alias("week_start"), "lane_id", "mode")
        .agg(F.count("shipment_id").alias("shipment_count"), F.avg("cpl").alias("avg_cpl"))
    )
    w = Window.partitionBy("lane_id", "mode").orderBy("week_start")
    four = w.rowsBetween(-4, -1)
    rolled = weekly.withColumn("rolling_4wk", F.when(F.count("avg_cpl").over(four) == 4, F.avg("avg_cpl").over(four))).withColumn("prior_weeks", (F.row_number().over(w) - 1).cast("long"))
    off = (F.col("avg_cpl") - F.col("rolling_4wk")) / F.when(F.col("rolling_4wk") < 1e-6, F.lit(1e-6)).otherwise(F.col("rolling_4wk"))
    late = (F.abs("pct_dev") > DEVIATION) & (F.col("prior_weeks") >= PRIOR_WEEKS)
    return rolled.withColumn("pct_dev", off).select("week_start", "lane_id", "mode", "shipment_count", "avg_cpl", "rolling_4wk", "pct_dev", "prior_weeks", F.when(late, 1).otherwise(0).alias("is_anomalous"))


def cpl_distribution(marked: DataFrame) -> DataFrame:
    """Box of cost per pound by mode and flag."""
    label = F.when(F.col("flagged") == 1, "Flagged").otherwise("Normal")
    named = marked.select("mode", label.alias("anomaly_label"), "cpl")
    box = percentiles(named, ["mode", "anomaly_label"], "cpl", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    ends = named.groupBy("mode", "anomaly_label").agg(F.count("cpl").alias("n"), F.min("cpl").alias("low"), F.max("cpl").alias("high"))
    return ends.join(box, ["mode", "anomaly_label"]).select("mode", "anomaly_label", "n", "low", "q1", "median", "q3", "high")


def weekly_cpl(ships: DataFrame) -> DataFrame:
    """By week, labelled by its Sunday: the plain mean over days and modes of daily means; weeks without rows are null."""
    daily = ships.withColumn("cpl", cost_per_lb_floored()).where("ship_date is not null and mode is not null").groupBy("ship_date", "mode").agg(F.avg("cpl").alias("avg_cpl"))
    weekly = daily.groupBy(week_end(F.col("ship_date")).alias("week")).agg(F.avg("avg_cpl").alias("avg_cpl"))
    weeks = weekly.agg(F.min("week").alias("a"), F.max("week").alias("b")).where("a is not null").select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week"))
    return weeks.join(weekly, "week", "left").orderBy("week")


def anomalous_weeks(trends: DataFrame) -> DataFrame:
    return trends.where("is_anomalous = 1").select("week_start").distinct()


def top_lanes(marked: DataFrame, k: int = 20) -> DataFrame:
    """The k lanes of greatest spend, least first."""
    lanes = marked.where("lane_id is not null").groupBy("lane_id").agg(F.sum("total_cost").alias("total_cost"), F.sum("flagged").alias("anomaly_count"), F.count("shipment_id").alias("total_count"))
    top = lanes.orderBy(F.desc("total_cost"), "lane_id").limit(k)
    return top.withColumn("anomaly_density", F.col("anomaly_count") / F.greatest("total_count", F.lit(1))).orderBy("total_cost")


def carrier_scatter(ships: DataFrame) -> DataFrame:
    return ships.where("carrier_id is not null").groupBy("carrier_id").agg(F.avg("on_time_flag").alias("on_time_rate"), F.avg("total_cost").alias("avg_cost"), F.count("shipment_id").alias("volume"))


def flag_breakdown(ships: DataFrame, k: int = 10) -> DataFrame:
    """Per lane: flags by Z-score only, by both and by quartiles only; the k lanes with most."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    lanes = local_marks(ships).where("lane_id is not null").groupBy("lane_id").agg(n(F.expr("z > q")).alias("zscore_only"), n(F.expr("z = 1 and q = 1")).alias("both"), n(F.expr("q > z")).alias("iqr_only"))
    return lanes.withColumn("total_flags", F.col("zscore_only") + F.col("both") + F.col("iqr_only")).orderBy(F.desc("total_flags"), "lane_id").limit(k)




def lane_panel(risk: DataFrame, k: int = 3) -> DataFrame:
    """The k lanes of greatest risk for a chart: rates in percent and the overrun as a share of the greatest of them."""
    top = risk.orderBy(F.desc_nulls_last("risk_score"), "lane_id").limit(k)
    return top.select("lane_id", "anomaly_rate_pct", "late_rate_pct", "cost_overrun_pct", (F.col("cost_overrun_pct") / F.nullif(F.max("cost_overrun_pct").over(Window.partitionBy()), F.lit(0.0))).alias("overrun_share"))
