"""URL filters [native]: a sort-merge range join of urls with host and path rules.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. For each
suffix of a url's host, the canonical key is the suffix's labels in reverse order, a slash and the path: a rule
is then a prefix of keys, that is an interval of the sorted keys, and intervals of two rules are nested or
disjoint. The sweep reads keys and interval borders in one sort order and carries the stack of open rules, which
each border states; the top of the stack is the longest rule of that host suffix. The longest over a url's
suffixes wins.

Scale: urls are dealt to sweeps by a row number, so that a host with a third of all rows is spread evenly; each
sweep gets its own copy of the rules' borders through the shuffle and merges it with its urls in sorted, spillable
order (no broadcast, no task that holds a host). A url's row travels with the first of its keys only, so callers with
wide tables select what they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.shared import LOWER, UPPER, partitions

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), path).cast("binary")


def borders(rules: DataFrame) -> DataFrame:
    """Interval borders of the rules with the stack of open rules from there on, outermost first."""
    rules = (
        rules.where("host is not null and host <> '' and path is not null and action is not null")
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
        .agg(F.max("action").alias("action"))
        .select(
            _key(F.reverse(F.split("host", r"\.")), F.col("path")).alias("at"),
            F.struct(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), "action").alias("r"),
        )
    )
    ends = F.sequence(F.lit(1), F.length("at"))
    nested = (
        rules.select("at", F.explode(ends).alias("n"))
        .select("at", "n", F.expr("substring(at, 1, n)").alias("outer_at"))
        .join(rules.select(F.col("at").alias("outer_at"), F.col("r").alias("outer_r")), "outer_at")
        .groupBy("at")
        .agg(F.array_sort(F.collect_list(F.struct("n", F.col("outer_r").alias("r")))).alias("s"))
        .select("at", F.col("s.r").alias("stack"))
    )
    return nested.select("at", "stack").unionByName(
        nested.select(F.concat("at", F.unhex(F.lit("FF"))).alias("at"), F.expr("slice(stack, 1, size(stack) - 1)").alias("stack"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The columns of ``pages`` with host, path, rule and verdict.

    ``rules``: host, path, action. The longest fitting rule (host plus path; at a tie the longer host) gives the
    verdict; without one, rule is null and the verdict ``default``. Rules with a null or an empty host fit nothing;
    of two equal rules the greater action counts (block before allow). A null url, or one without ``://``, has an
    empty host and path and meets no rule. Equal rows stay as many rows; columns of ``pages`` that are named like
    the results are replaced.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    deals = 4 * partitions(spark)
    parts = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).alias("row"),
        F.monotonically_increasing_id().alias("rid"),
    )
    labels = F.reverse(F.split("row.host", r"\."))
    levels = F.when(F.col("row.host") != "", F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest))))
    keys = (
        parts.withColumn("labels", labels)
        .select("row", "rid", "labels", F.explode_outer(levels).alias("level"))
        .select(
            F.expr(f"pmod(xxhash64(rid), {deals})").alias("deal"),
            _key(F.slice("labels", F.lit(1), F.coalesce("level", F.lit(1))), F.col("row.path")).alias("at"),
            F.lit(1).alias("side"),
            "rid",
            F.when(F.coalesce("level", F.lit(1)) == 1, F.col("row")).alias("row"),
        )
    )
    stops = borders(rules).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"), "at", F.lit(0).alias("side"), "stack")
    sweep = Window.partitionBy("deal").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = (
        keys.unionByName(stops, allowMissingColumns=True)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("side = 1")
        .withColumn("top", F.expr("try_element_at(open, -1)"))
        .groupBy("deal", "rid")
        .agg(
            F.first("row", ignorenulls=True).alias("row"),
            F.max(F.when(F.col("top").isNotNull(), F.struct(F.length("top.rule").alias("n"), F.col("top.host_len").alias("h"), "top"))).alias("best"),
        )
    )
    return met.select("row.*", F.col("best.top.rule").alias("rule"), F.coalesce("best.top.action", F.lit(default)).alias("verdict"))
