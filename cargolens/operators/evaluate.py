"""Local detectors with adaptive peer groups, and metrics against labelled truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import cost_per_lb_floored, percentiles, sized
from cargolens.schemas import IQR_FACTOR, LOCAL_COVERAGE, LOCAL_MIN_GROUP, Z_THRESHOLD

CANDIDATES = [["lane_id", "mode"], ["carrier_id"], ["mode"]]


def group_coverage(ships: DataFrame, min_group: int = LOCAL_MIN_GROUP) -> DataFrame:
    """Share of all rows in groups of enough measured rows, for each candidate grouping; one job over grouping sets."""
    total = ships.agg(F.count("*").alias("total"))
    sets = ships.withColumn("cpl", cost_per_lb_floored()).groupingSets([[F.col(c) for c in g] for g in CANDIDATES], "lane_id", "mode", "carrier_id")
    counted = sets.agg(F.grouping_id("lane_id", "mode", "carrier_id").alias("gid"), F.count("cpl").alias("n"))
    place = F.when(F.col("gid") == 1, 0).when(F.col("gid") == 6, 1).otherwise(2)
    whole = F.when(F.col("place") == 0, F.col("lane_id").isNotNull() & F.col("mode").isNotNull()).when(F.col("place") == 1, F.col("carrier_id").isNotNull()).otherwise(F.col("mode").isNotNull())
    eligible = F.when(whole & (F.col("n") >= min_group), F.col("n")).otherwise(0)
    covered = counted.withColumn("place", place).groupBy("place").agg(F.sum(eligible).alias("covered"))
    names = F.array(*[F.lit("+".join(g)) for g in CANDIDATES])
    return covered.crossJoin(total).select(
        F.col("place"), F.element_at(names, F.col("place") + 1).alias("grouping"), F.col("covered").alias("covered_rows"), F.coalesce(F.col("covered") / F.nullif(F.col("total").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("coverage")
    )


def choose_grouping(ships: DataFrame, least: float = LOCAL_COVERAGE) -> list[str]:
    """The first grouping with enough coverage, else the first of the greatest coverage, else none (global statistics)."""
    rows = sorted(group_coverage(ships).collect(), key=lambda r: r.place)  # three rows
    for r in rows:
        if r.coverage >= least:
            return CANDIDATES[r.place]
    best = max(rows, key=lambda r: (r.coverage, -r.place), default=None)
    return CANDIDATES[best.place] if best and best.covered_rows > 0 else []


def local_marks(ships: DataFrame, threshold: float = Z_THRESHOLD, factor: float = IQR_FACTOR) -> DataFrame:
    """``ships`` with cpl and the flags z and q, 0 or 1: outliers against the adaptive peer group by Z-score and by quartiles.

    The grouping is chosen once; statistics are joined as one row a group, or as the one row of all. The deviation has
    a floor of 1e-6.
    """
    keys = choose_grouping(ships)
    costed = ships.withColumn("cpl", cost_per_lb_floored())
    rows, by = (costed.dropna(subset=keys), keys) if keys else (costed.withColumn("__all", F.lit(1)), ["__all"])
    means = rows.groupBy(*by).agg(F.avg("cpl").alias("mean"), F.stddev_samp("cpl").alias("std"))
    stats = percentiles(rows, by, "cpl", {"q1": 0.25, "q3": 0.75}).join(means, by)
    if keys:
        met = costed.join(sized(stats.where(F.col("n") >= LOCAL_MIN_GROUP)), keys, "left")
    else:
        met = costed.join(F.broadcast(stats.drop("__all")), F.lit(True), "left")  # one row, none without shipments
    z = F.abs((F.col("cpl") - F.col("mean")) / F.when(F.col("std") < 1e-6, F.lit(1e-6)).otherwise(F.col("std"))) > threshold
    spread = factor * (F.col("q3") - F.col("q1"))
    q = (F.col("cpl") > F.col("q3") + spread) | (F.col("cpl") < F.col("q1") - spread)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return met.select(*costed.columns, flag(z).alias("z"), flag(q).alias("q"))


def local_zscore_flags(ships: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    return local_marks(ships, threshold=threshold).where("z = 1").select("shipment_id").distinct()


def local_iqr_flags(ships: DataFrame) -> DataFrame:
    return local_marks(ships).where("q = 1").select("shipment_id").distinct()


def metrics_by(flagged: DataFrame, truth: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """A row for each method of ``flagged`` (method, shipment_id), and for each of ``methods``: confusion counts, precision,
    recall, f1, fpr and n_flagged. Flagged ids that truth lacks are false positives. One join with truth."""
    known = truth.groupBy("shipment_id").agg(F.sum("is_anomaly").alias("a"))
    hits = flagged.select("method", "shipment_id").distinct().join(known, "shipment_id", "left").groupBy("method").agg(F.count("*").alias("n_flagged"), F.coalesce(F.sum("a"), F.lit(0)).alias("tp"))
    if methods:
        named = flagged.sparkSession.createDataFrame([(m,) for m in methods], "method string")
        hits = named.join(hits, "method", "full").select("method", F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"), F.coalesce("tp", F.lit(0)).alias("tp"))
    total = truth.agg(F.count("*").alias("n"), F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("positive"))
    counts = hits.crossJoin(F.broadcast(total)).select(  # one row
        "method", F.col("tp").cast("long").alias("tp"), (F.col("n_flagged") - F.col("tp")).alias("fp"), (F.col("positive") - F.col("tp")).alias("fn"),
        (F.col("n") - F.col("positive") - F.col("n_flagged") + F.col("tp")).alias("tn"), F.col("n_flagged").cast("long").alias("n_flagged"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = counts.withColumn("p", share(tp, tp + fp)).withColumn("r", share(tp, tp + fn))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    return rated.select("method", "tp", "fp", "fn", "tn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round(share(fp, fp + tn), 4).alias("fpr"), "n_flagged")


def metrics(flagged: DataFrame, truth: DataFrame, method: str) -> DataFrame:
    """The row of one method's flagged ids."""
    return metrics_by(flagged.select(F.lit(method).alias("method"), "shipment_id"), truth, [method])


def eval_metrics(ships: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics of each local method and of their union."""
    marks = local_marks(ships).where("z = 1 or q = 1")
    kinds = F.array_compact(F.array(F.when(F.col("z") == 1, "ZSCORE"), F.when(F.col("q") == 1, "IQR"), F.lit("ALL")))
    return metrics_by(marks.select(F.explode(kinds).alias("method"), "shipment_id"), truth, ["ZSCORE", "IQR", "ALL"])


def metrics_from_export(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """The same from exported flags (flag_type, shipment_id): for each type that they have, and for all."""
    both = flags.where("flag_type is not null").select(F.col("flag_type").alias("method"), "shipment_id").unionByName(flags.select(F.lit("ALL").alias("method"), "shipment_id"))
    return metrics_by(both, truth, ["ALL"])


def metrics_as_text(rated: DataFrame) -> DataFrame:
    """Rows of metrics as a report shows them: three places, thousands apart, ALL last as 'ALL (distinct)'."""
    shown = [F.format_number(F.coalesce(c, F.lit(0.0)), 3).alias(name) for c, name in ((F.col("precision"), "Precision"), (F.col("recall"), "Recall"), (F.col("f1"), "F1"), (F.col("fpr"), "FPR"))]
    every = F.col("method") == "ALL"
    return rated.orderBy(every, "method").select(F.when(every, "ALL (distinct)").otherwise(F.col("method")).alias("Method"), *shown, F.format_number("n_flagged", 0).alias("Flagged"))
