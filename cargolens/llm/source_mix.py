"""Mixing sources to target weights [native]: Efraimidis-Spirakis sampling to token budgets.

Sources share a budget by weight; a target stops at ``most`` times its source's size and the excess is shared
again by weight until none is above. That is water filling: with sources in the order of cap / weight, those up to
some place are capped and the others get ``weight * level``. A source's target is spent in complete epochs first.
What is left goes to the fractional selection: each document gets the exponential key -ln(u) / quality, documents
are taken in the order of keys, and the running total of sizes is cut at the budget (the document on the border
gives its first words).

Scale: u is a hash of the document, so that reruns and lost executors give the same draw. The running total is a
two-level prefix sum: a source's keys are cut into about sqrt(rows) ranges of equal probability; totals of ranges
are summed up within the source, rows only within their range. A source with a third of all rows is thus spread
over many tasks. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.shared import n_words, written

SALTS = 64
#: Marks that are rare in prose. Their share lowers a document's quality weight.
MARKS = "#$%&*!|"


def prose_weight(text: Column) -> Column:
    """Quality weight in [0.05, 1]: one less five times the share of marks; 1 for null and empty texts."""
    n = F.length(text)
    marks = F.regexp_count(text, F.lit(f"[{MARKS}]"))
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.05), 1 - F.lit(5.0) * marks / n)), F.lit(1.0))


def uniform(row_key: Column, seed: int) -> Column:
    """In (0, 1): the first 52 bits of a hash."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row_key)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def _placed(sizes: DataFrame) -> DataFrame:
    """Adds place, the number of a source in the order of names from 0: dealt by ranges of names, counted within a range."""
    ranges = written(sizes.repartitionByRange("no_source", "source").withColumn("range", F.spark_partition_id()))
    # as many rows as partitions
    counts = ranges.groupBy("range").agg(F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("range").orderBy("no_source", "source"))
    return ranges.join(counts.select("range", before.alias("before")), "range").withColumn("place", F.col("before") + within - 1).drop("range", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds target to one row per source: no_source, source, source_size, n_docs (as many rows as sources).

    The level is found by rounds: with the sources capped that lie below the level, the rest of the budget gives the next
    one. It only rises, so the capped sources only become more, and the round that caps no further one has it. A round is an aggregate
    of one row, so that sources may be as many as hosts.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = written(
        _placed(sizes)
        .withColumn("weight", F.get(cycle, F.expr(f"place % {len(weights)}")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    budget = float(share) * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = float("-inf"), -1
    while True:
        capped = F.col("ratio") < F.lit(level)
        n, full, weight = weighed.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == n_capped or weight is None:
            break
        n_capped, level = n, (budget - full) / weight
    # without a source that is not capped, or without any, every target is the cap
    below = F.lit(True) if weight is None else F.col("ratio") < F.lit(level)
    return weighed.withColumn("target", F.when(below, F.col("cap")).otherwise(F.col("weight") * F.lit(level))).select("no_source", "source", "source_size", "n_docs", "mean_quality", "target")


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 1,
) -> DataFrame:
    """Per row: doc_id, size, source_size, target (double), taken (long), with source.

    Sources in the order of code points, null last, weigh ``weights``, again and again; they share ``share`` times
    all words; a target is at most ``most`` times its source's words. taken is the words that the mix takes of the
    row, repeats counted: complete epochs of the whole text plus, for rows drawn into the last, part epoch, the
    text once more (the row on the border only up to the budget). Null and empty texts have size 0 and give 0.
    Rows with equal doc_id and text tie; which of them is drawn first cannot be told apart. A source of size 0 has
    target 0. An empty table gives no rows.
    """
    words = n_words(F.col(text))
    rows = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).isNull().alias("no_source"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
            words.alias("size"),
            prose_weight(F.col(text)).alias("quality"),
            F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        )
    )
    rows = rows.withColumn("u", uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed))
    sizes = rows.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.avg("quality").alias("mean_quality"))
    plan = targets(sizes, weights, share, most).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = (
        rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id, digest), {SALTS}) as int)"))
        .join(plan, ["no_source", "source", "salt"])
        .withColumn("draw", -F.ln("u") / F.col("quality"))
        # equal shares of draws: 1 - exp(-draw * mean) is uniform where all qualities are equal, and it keeps the order
        .withColumn("part", F.floor(F.ceil(F.sqrt("n_docs")) * (1 - F.exp(-F.col("draw") * F.col("mean_quality")))))
        .drop("salt", "quality", "mean_quality", "n_docs", "u")
    )
    totals = keyed.groupBy("no_source", "source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("no_source", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0))).drop("part_size")
    within = Window.partitionBy("no_source", "source", "part").orderBy("draw", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        keyed.join(offsets, ["no_source", "source", "part"])
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))))
        .select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.when(~F.col("no_source"), F.col("source")).alias("source"))
    )


def mixed_texts(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: doc_id, epoch and text, each document as often as ``plan`` takes it; the last one cut at a word's end.

    doc_id must be a key of both. Null and empty texts give no rows.
    """
    pieces = plan.where("taken > 0").select(F.col("doc_id").alias(doc_id), "size", F.explode(F.expr("transform(sequence(0, cast(ceil(taken / size) - 1 as int)), e -> struct(e as epoch, least(size, taken - e * size) as n))")).alias("p"))
    short = F.array_join(F.slice(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]"), lambda w: w != ""), F.lit(1), F.col("p.n").cast("int")), " ")
    return docs.select(doc_id, text).join(pieces, doc_id).select(doc_id, F.col("p.epoch").alias("epoch"), F.when(F.col("p.n") < F.col("size"), short).otherwise(F.col(text)).alias(text))
