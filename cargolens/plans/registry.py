"""All queries of the engine by name, over shipments made from the star schema, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions.measures import kept, release
from cargolens.operators import adhoc, datasets, detect, evaluate, generate, quality, views
from cargolens.plans import oracle
from cargolens.sources import adapter, sinks

Query = Callable[[SparkSession, str], DataFrame]


SUMS = ("total_spend", "total_freight_spend")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places, great sums to two: sums in another order differ in the last bits.

    At nine places first, where such bits are gone, so that a value that is half way between two of six places goes up
    in any order of summation.
    """

    def shown(c: str) -> Column:
        return F.round(F.col(c), 2) if c in SUMS else F.round(F.round(F.col(c), places + 3), places)

    return df.select(*[shown(c).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "decimal(20,0)") else F.col(c) for c, t in df.dtypes])


#: What detectors, views and evaluation read of shipments.
READ = ["shipment_id", "ship_date", "origin_city", "mode", "carrier_id", "weight_lbs", "total_cost", "on_time_flag", "lane_id", "is_anomaly"]


def _once(f: Callable[[DataFrame], DataFrame], lane: str = adapter.LANE) -> Query:
    """For what reads shipments once; columns are pruned by the plan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        release()
        return rounded(f(adapter.shipments(spark, sf_dir, lane)))

    return run


def _ships(f: Callable[[DataFrame], DataFrame], lane: str = adapter.LANE) -> Query:
    """For what reads shipments several times: their columns are kept until the next query, spilling to disk."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        release()
        return rounded(f(kept(adapter.shipments(spark, sf_dir, lane).select(READ))))

    return run


def _flagged(f: Callable[[DataFrame, DataFrame], DataFrame], lane: str = adapter.LANE) -> Query:
    return _ships(lambda s: f(s, detect.anomaly_flags(s)), lane)


def _marked(f: Callable[[DataFrame], DataFrame], lane: str = adapter.LANE) -> Query:
    """Views of flags in place, without a join on shipment_id."""
    return _ships(lambda s: f(detect.marked(s)), lane)


def _labelled(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _ships(lambda s: f(views.labelled(s, adapter.truth(s))))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    release()
    ships = kept(adapter.shipments(spark, sf_dir))
    tables = {"SHIPMENTS": ships, "FUEL_SURCHARGES": adapter.fuel(spark), "CARRIER_RATES": adapter.rates(ships), "LANE_WEEK_TRENDS": detect.lane_week_trends(ships), "ANOMALY_FLAGS": detect.anomaly_flags(ships)}
    return quality.row_counts(tables, {"SHIPMENTS": 75_000, "FUEL_SURCHARGES": 100, "CARRIER_RATES": 1_000})


def _exported_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    release()
    ships = kept(adapter.shipments(spark, sf_dir))
    flags = detect.anomaly_flags(ships)
    upper = flags.select(F.col("flag_type").alias("FLAG_TYPE"), F.col("shipment_id").alias("SHIPMENT_ID"))
    return rounded(evaluate.metrics_from_export(upper.toDF(*[c.lower() for c in upper.columns]), adapter.truth(ships)))


def _raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones and modes of flows out of orders, for the parser of raw flows."""
    o = adapter.table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 560).cast("string").alias("dms_orig"), (F.col("o_custkey") % 560).cast("string").alias("dms_dest"), (F.col("o_orderkey") % 8).cast("string").alias("dms_mode"))


def _generated(spark: SparkSession, _: str) -> DataFrame:
    made = generate.shipments(generate.carrier_rates(spark), generate.fuel_surcharges(spark))
    return rounded(made[0].join(made[1].select("shipment_id", "is_anomaly"), "shipment_id"))


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapter.shipments(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("is_anomaly").alias("a")).first()
    row = {"run_id": "run-1", "generated_at": "2024-01-01T00:00:00", "seed_source": "TEST", "n_shipments": n.n, "n_anomalies": n.a, "anomaly_rate": round(n.a / n.n, 4)}
    return rounded(sinks.generation_run(spark, row)).drop("generated_at")


def _week_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.anomalous_weeks(datasets.lane_week_trends(adapter.shipments(spark, sf_dir)))


def queries() -> dict[str, Query]:
    nation = adapter.NATION_LANE
    fuel_costs = lambda spark, sf_dir: rounded(adhoc.fuel_vs_cost(adapter.fuel(spark), adapter.shipments(spark, sf_dir)))
    return {
        "flag_zscore": _ships(detect.zscore_flags),
        "flag_iqr": _ships(detect.iqr_flags),
        "anomaly_flags": _flagged(lambda s, f: f),
        "flag_counts": _flagged(lambda s, f: detect.flag_counts(f)),
        "flagged_distinct": _flagged(lambda s, f: detect.flagged_distinct(f)),
        "lane_week_trends": _once(detect.lane_week_trends),
        "trend_summary": _once(lambda s: detect.trend_summary(detect.lane_week_trends(s))),
        "vw_carrier_ontime": _once(views.carrier_ontime),
        "vw_cost_by_mode_region": _ships(views.cost_by_mode_region),
        "vw_anomaly_rate_by_region": _marked(views.anomaly_rate_of),
        "vw_carrier_scorecard": _marked(views.carrier_scorecard_of),
        "vw_executive_summary": _marked(views.executive_summary_of),
        "vw_lane_risk": _marked(views.lane_risk_of),
        "vw_anomaly_rate_by_region_export": _labelled(views.anomaly_rate_export),
        "vw_carrier_scorecard_export": _labelled(views.carrier_scorecard_export),
        "vw_executive_summary_export": _ships(lambda s: views.executive_summary(s, adapter.truth(s).where("is_anomaly = 1"))),
        "vw_lane_risk_export": _labelled(views.lane_risk_export),
        "top_expensive_lanes": _once(adhoc.top_expensive_lanes),
        "top_carrier_anomaly": _flagged(adhoc.top_carrier_anomaly),
        "monthly_cost_trend": _once(adhoc.monthly_cost_trend),
        "fuel_vs_cost": fuel_costs,
        "flag_detail": _flagged(lambda s, f: adhoc.flag_detail(f, s)),
        "eval_zscore_flags": _ships(evaluate.local_zscore_flags),
        "eval_iqr_flags": _ships(evaluate.local_iqr_flags),
        "group_coverage": _ships(evaluate.group_coverage),
        "eval_metrics": _ships(lambda s: evaluate.eval_metrics(s, adapter.truth(s))),
        "eval_metrics_text": _ships(lambda s: evaluate.metrics_as_text(evaluate.eval_metrics(s, adapter.truth(s)))),
        "eval_from_export": _exported_flags,
        "validate_counts": _counts,
        "validate_nulls": _once(quality.null_counts),
        "validate_flag_rate": _flagged(quality.flag_rate),
        "validate_ontime": _once(quality.ontime_by_mode),
        "rates_duplicate_keys": _once(lambda s: quality.duplicate_keys(adapter.rates(s), ["carrier_id", "mode", "lane_id"])),
        "join_coverage": _once(lambda s: quality.join_coverage(s, adapter.rates(s))),
        "base_cost_check": _once(quality.base_cost_error),
        "dash_kpis": _ships(lambda s: datasets.kpis(datasets.flagged(s))),
        "dash_flagged": _ships(lambda s: datasets.flagged(s).select("shipment_id", "cpl", "flagged")),
        "dash_lane_week_trends": _once(datasets.lane_week_trends),
        "dash_anomalous_weeks": _week_flags,
        "dash_cpl_distribution": _ships(lambda s: datasets.cpl_distribution(datasets.flagged(s))),
        "dash_weekly_cpl": _ships(datasets.weekly_cpl),
        "dash_top_lanes": _ships(lambda s: datasets.top_lanes(datasets.flagged(s)).withColumn("total_cost", F.round("total_cost", 2))),
        "dash_carrier_scorecard": _once(datasets.carrier_scatter),
        "chart_lane_risk": _ships(lambda s: datasets.lane_panel(views.lane_risk_export(views.labelled(s, adapter.truth(s))))),
        "flag_breakdown": _ships(datasets.flag_breakdown),
        "run_provenance": _provenance,
        "carrier_rates": _once(adapter.rates),
        "fuel_surcharges": lambda spark, _: rounded(generate.fuel_surcharges(spark)),
        "faf_lane_weights": lambda spark, sf_dir: generate.lane_weights(_raw_flows(spark, sf_dir)),
        "faf_mode_share": lambda spark, sf_dir: rounded(generate.mode_shares(_raw_flows(spark, sf_dir).where("dms_mode <> '0'"))),
        "gen_rates": lambda spark, _: rounded(generate.carrier_rates(spark)),
        "gen_shipments": _generated,
        "flag_zscore_nation": _ships(detect.zscore_flags, nation),
        "flag_iqr_nation": _ships(detect.iqr_flags, nation),
        "lane_week_trends_nation": _once(lambda s: detect.lane_week_trends(s, min_weekly=2), nation),
        "vw_lane_risk_nation": _flagged(views.lane_risk, nation),
        "top_expensive_lanes_nation": _once(adhoc.top_expensive_lanes, nation),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
