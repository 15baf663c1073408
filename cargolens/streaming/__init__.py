"""Flags on a stream of shipments.

The batch engine has no streaming of its own; this gives its detectors' fences to a stream: shipments of a stream
are compared with statistics of a finished batch, a stateless join of the stream with a small static frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import cost_per_lb, sized
from cargolens.schemas import MIN_GROUP, Z_THRESHOLD


def zscore_flags_stream(stream: DataFrame, history: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Shipments of ``stream`` beyond ``threshold`` deviations of the mean that lane and mode have in ``history``."""
    keys = ["lane_id", "mode"]
    stats = history.groupBy(*keys).agg(F.avg(cost_per_lb()).alias("m"), F.stddev_samp(cost_per_lb()).alias("d"), F.count("*").alias("n")).where(F.col("n") >= MIN_GROUP)
    z = (cost_per_lb() - F.col("m")) / F.nullif(F.col("d"), F.lit(0.0))
    return stream.join(sized(stats), keys).withColumn("z_score", z).where(F.abs("z_score") > threshold).drop("m", "d", "n")
