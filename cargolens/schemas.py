"""Schemas of the data model and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

S, D, I, L, DT, TS = StringType(), DoubleType(), IntegerType(), LongType(), DateType(), TimestampNTZType()


def _table(*columns: tuple) -> StructType:
    return StructType([StructField(c[0], c[1], len(c) < 3) for c in columns])


# A third entry marks columns that must not be null.
SHIPMENTS = _table(
    ("shipment_id", S, 1), ("ship_date", DT, 1), ("origin_city", S, 1), ("dest_city", S, 1), ("mode", S, 1), ("carrier_id", S, 1), ("weight_lbs", D, 1),
    ("base_rate_per_cwt", D, 1), ("base_cost", D, 1), ("fuel_surcharge_pct", D, 1), ("total_cost", D, 1), ("on_time_flag", I, 1), ("lane_id", S, 1), ("run_id", S),
)
CARRIER_RATES = _table(("carrier_id", S, 1), ("mode", S, 1), ("lane_id", S, 1), ("base_rate_per_cwt", D, 1), ("effective_date", DT, 1))
FUEL_SURCHARGES = _table(("week_start", DT, 1), ("fuel_price_per_gallon", D, 1), ("surcharge_pct", D, 1))
ANOMALY_FLAGS = _table(("flag_id", S, 1), ("shipment_id", S, 1), ("flag_type", S, 1), ("lane_id", S), ("mode", S), ("region", S), ("cost_value", D), ("z_score", D), ("flag_date", DT), ("created_at", TS))
LANE_WEEK_TRENDS = _table(
    ("week_start", DT, 1), ("lane_id", S, 1), ("mode", S, 1), ("shipment_count", L), ("avg_cost_per_lb", D), ("rolling_4wk_avg", D), ("pct_deviation", D), ("is_anomalous", I)
)
GENERATION_RUNS = _table(("run_id", S, 1), ("generated_at", TS, 1), ("seed_source", S, 1), ("faf5_file", S), ("n_shipments", L), ("n_anomalies", L), ("anomaly_rate", D))
#: Tables by name; shipments lie in a folder for each mode.
TABLES = {
    "generation_runs": GENERATION_RUNS, "shipments": SHIPMENTS, "carrier_rates": CARRIER_RATES, "fuel_surcharges": FUEL_SURCHARGES,
    "anomaly_flags": ANOMALY_FLAGS, "lane_week_trends": LANE_WEEK_TRENDS,
}
GROUND_TRUTH = _table(("shipment_id", S), ("is_anomaly", I), ("run_id", S))
FLOWS = _table(("dms_orig", S), ("dms_dest", S), ("dms_mode", S))

# Fixed values of the domain.
Z_THRESHOLD, IQR_FACTOR, MIN_GROUP = 2.5, 1.5, 10
MIN_WEEKLY, PRIOR_WEEKS, DEVIATION = 5, 4, 0.20
LOCAL_MIN_GROUP, LOCAL_COVERAGE = 5, 0.60
MIN_LANE, RISK_WEIGHTS, OVERRUN_CAP = 50, (0.4, 0.3, 0.3), 10
MODES = ("PARCEL", "LTL", "FTL")
MODE_SHARES = (0.40, 0.35, 0.25)
FLOW_MODES = {1: "PARCEL", 2: "LTL", 3: "FTL", 4: "FTL", 5: "LTL", 6: "FTL", 7: "LTL"}
STATE_CODES = {
    4: "AZ", 6: "CA", 8: "CO", 12: "FL", 13: "GA", 17: "IL", 18: "IN", 21: "KY", 24: "MD", 25: "MA", 26: "MI",
    27: "MN", 29: "MO", 36: "NY", 37: "NC", 39: "OH", 41: "OR", 42: "PA", 47: "TN", 48: "TX", 49: "UT", 53: "WA",
}
CITIES = (
    "Chicago,IL", "Los Angeles,CA", "New York,NY", "Dallas,TX", "Atlanta,GA", "Seattle,WA", "Denver,CO", "Memphis,TN", "Houston,TX", "Detroit,MI",
    "Philadelphia,PA", "Phoenix,AZ", "Minneapolis,MN", "Kansas City,MO", "Charlotte,NC", "Portland,OR", "Cincinnati,OH", "Nashville,TN", "Salt Lake City,UT", "Miami,FL",
    "Boston,MA", "St. Louis,MO", "Louisville,KY", "Columbus,OH", "Indianapolis,IN", "San Antonio,TX", "San Jose,CA", "Baltimore,MD", "Pittsburgh,PA", "Cleveland,OH",
)
RATES = {"PARCEL": (12.0, 4.0), "LTL": (18.5, 5.5), "FTL": (8.0, 2.0)}
ON_TIME = {"PARCEL": 0.92, "LTL": 0.87, "FTL": 0.94}
DIESEL = ((3.50, 5.80), (5.80, 4.20), (4.20, 4.00), (4.00, 3.80), (3.80, 3.90))  # 26 weeks each, from 2022-01-03
EXPECTED_ROWS = {"SHIPMENTS": 75_000, "FUEL_SURCHARGES": 100, "CARRIER_RATES": 1_000}
