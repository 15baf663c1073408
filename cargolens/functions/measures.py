"""Measures and time buckets as column expressions, and two helpers on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES, SMALL_GROUP = 32 << 20, 100_000


def cost_per_lb() -> Column:
    """Null where the weight is zero or null."""
    return F.col("total_cost") / F.nullif(F.col("weight_lbs"), F.lit(0.0))


def cost_per_lb_floored() -> Column:
    """The evaluator's variant: weights have a floor of 1e-6; a null weight stays null."""
    return F.col("total_cost") / F.when(F.col("weight_lbs") < 1e-6, F.lit(1e-6)).otherwise(F.col("weight_lbs"))


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def month_start(day: Column) -> Column:
    return F.date_trunc("month", day).cast("date")


def week_end(day: Column) -> Column:
    """The Sunday that ends the week."""
    return F.date_add(week_start(day), 6)


def origin_state(strict: bool = False) -> Column:
    """What follows the first comma of origin_city: '' without one, or null where ``strict`` (then all that follows)."""
    return F.get(F.split("origin_city", ",", 2), 1) if strict else F.split_part("origin_city", F.lit(","), F.lit(2))


def least_or_null(c: Column, most: float) -> Column:
    """Null if ``c`` is null, unlike ``least``."""
    return F.when(c.isNotNull(), F.least(c, F.lit(float(most))))


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted until ``release``."""
    _KEPT.append(df.persist())
    return df


def release() -> None:
    """Unpersists what ``kept`` holds. Frames that still read it compute it again."""
    while _KEPT:
        _KEPT.pop().unpersist()


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if its measured size is at most ``most`` bytes, else leave the join to the shuffle.

    The size is 16 bytes a value and the bytes of strings, in one job over the frame, which is kept for the join.
    """
    df = kept(df)
    chars = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"), F.lit(0))
    size = df.agg(F.coalesce(F.sum(chars + 16 * len(df.columns)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], accuracy: int = 4000, small: int = SMALL_GROUP) -> DataFrame:
    """Exact interpolated percentiles of a group in bounded memory: one row of keys, n and the names in ``shares``.

    Where no group has more than ``small`` values, they are aggregated as they are. Else a sketch with a rank error of
    at most 1/accuracy of the group gives a bracket around each percentile. Rows below the bracket are only counted, rows
    inside (about 4/accuracy of a group) are sorted and the two neighbours of the wanted rank interpolated. Null values
    are left out; groups without values give null percentiles. Both ways give the same rows.
    """
    if (df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0) <= small:
        return df.groupBy(*keys).agg(F.count(value).alias("n"), *[F.percentile(value, F.lit(float(p))).alias(name) for name, p in shares.items()])
    margin, names = 2.0 / accuracy, list(shares)
    marks = [x for p in shares.values() for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile_approx(value, marks, accuracy).alias("marks"), F.min(value).alias("low"), F.max(value).alias("high"))
    sketch = sized(sketch)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on &= c
    bracket = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.when(F.col("s.n") < accuracy, F.col("s.low")).otherwise(F.get("s.marks", F.lit(2 * i))).alias("from"),
                F.when(F.col("s.n") < accuracy, F.col("s.high")).otherwise(F.get("s.marks", F.lit(2 * i + 1))).alias("to"),
            )
            for i in range(len(names))
        ]
    )
    placed = (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).alias("__v"))
        .alias("d")
        .join(sketch.alias("s"), on)
        .select(*[F.col(f"d.{k}").alias(k) for k in keys], "__v", F.explode(F.filter(bracket, lambda b: F.col("__v") <= b["to"])).alias("b"))
        .select(*keys, F.col("b.i").alias("i"), F.when(F.col("__v") >= F.col("b.from"), F.col("__v")).alias("v"))
        # equal values are one row with a count: rows below the bracket collapse to one
        .groupBy(*keys, "i", "v")
        .agg(F.count("*").alias("c"))
    )
    order = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("v"))
    ranked = placed.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("v is not null")
    s = sketch.select(*[F.col(k).alias(f"__{k}") for k in keys], "n")
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    target = F.element_at(F.array(*[F.lit(float(p)) for p in shares.values()]), F.col("i") + 1) * (F.col("n") - 1)
    near = ranked.join(s, on).withColumn("r", target).select(*keys, "i", "v", "upto", "r")
    found = near.groupBy(*keys, "i").agg(
        F.min(F.when(F.col("upto") > F.floor("r"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("r"), F.col("v"))).alias("b"), F.first("r").alias("r")
    )
    exact = F.col("a") + (F.col("r") - F.floor("r")) * (F.col("b") - F.col("a"))
    wide = found.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[F.max(F.when(F.col("i") == i, exact)).alias(name) for i, name in enumerate(names)])
    return sketch.select(*keys, "n").join(sized(wide), on, "left").select(*keys, "n", *names)
