"""Line dedup [native]: a deletion-neighbourhood join on the words of lines.

Two lines are near where one word is replaced, put in or left out at most. Each line of n words stands for itself
and for n variants with one word deleted; two lines are near only if they share a variant, so an equi-join on
hashed variants finds every near pair. The edit distance of what was found is verified on the words, and a line
stays only if no equal or near line comes before it.

Scale. Equal lines are first brought down to one by a 128-bit hash; only hashes are shuffled. Near lines agree
either on their first or on their last words, so lines whose ends are met in no other line (most lines) need no
variants; that test is exact but for chance collisions of 64-bit hashes. Hashes of all variants of a line come from two running XORs, in linear time. Groups
of lines with one variant are aggregated to their earliest member, never paired with each other: a template with a
counter that fills a third of all lines costs one link a line. Joins that meet hot keys have a unique other side that
is a table, so both sides are plain shuffles and adaptive execution can split the hot one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.shared import dropped, written

AT = ["doc", "row", "line_no"]  # the place of a line: doc_id, a hash of doc_id and text, number of the line


#: White space but the space; line feeds end lines.
SPACES = "\t\x0b\x0c\r"


def _words(line: Column) -> Column:
    # translating looks up every character, so it is left to lines that need it
    odd = F.contains(line, F.lit(SPACES[0]))
    for c in SPACES[1:]:
        odd = odd | F.contains(line, F.lit(c))
    return F.array_remove(F.split(F.when(odd, F.translate(line, SPACES, " " * len(SPACES))).otherwise(line), " "), "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _without(words: Column, i: Column) -> Column:
    """The words but number i (from 0)."""
    return F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.greatest(F.size(words) - i - 1, F.lit(0))))


def _reach(n: Column) -> Column:
    """The largest of 0, 1, 2, 3, 4, 6, 8, 12, 16 and so on up to half of n: few lines differ in it from those one word shorter."""
    x = F.floor(n / 2).cast("int")
    power = F.pow(F.lit(2), F.length(F.bin(x)) - 1).cast("int")
    return F.when(x < 2, x).otherwise(F.when(x * 2 >= power * 3, F.floor(power * 3 / 2).cast("int")).otherwise(power))


def occurrences(docs: DataFrame, min_words: int, short_repeats: bool) -> DataFrame:
    """A row for each line of enough words: its place, two hashes of its words and the hashes of its ends.

    With ``short_repeats``, shorter lines but blank ones have a row too; they have no ends, so they are near to none.

    halves: the first and the last words, as many as ``_reach`` says for the number of words of the shorter line of a
    pair (n or n - 1); the two ends of the shorter line do not overlap, so that one edit leaves one of them equal.
    """
    w, n, line = F.col("w"), F.col("n"), F.col("line")
    # a filter on n would be moved below the words and make them twice
    enough = F.btrim(line, F.lit(" " + SPACES)) != "" if short_repeats else F.size(_words(line)) >= min_words
    ends = lambda m: [F.xxhash64(F.lit(0), F.slice(w, F.lit(1), m)), F.xxhash64(F.lit(1), F.slice(w, n - m + 1, m))]
    mine, shorter = F.col("mine"), F.col("shorter")
    halves = F.when(mine == shorter, F.array(*ends(mine))).otherwise(F.array(*ends(mine), *ends(shorter)))
    return (
        docs.select("doc", "row", F.posexplode(_lines(F.col("text"))).alias("line_no", "line"))
        .where(enough)
        .select(*AT, _words(line).alias("w"))
        .withColumn("n", F.size("w"))
        .withColumns({"mine": _reach(n), "shorter": _reach(n - 1)})
        .select(*AT, F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), (F.when(n >= min_words, halves).otherwise(F.array().cast("array<bigint>")) if short_repeats else halves).alias("halves"))
    )


def with_shared_end(lines: DataFrame) -> DataFrame:
    """h1 and h2 of the lines that have an end in common with a different line."""
    halves = lines.select("h1", "h2", F.explode("halves").alias("half"))
    shared = written(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half"))
    return halves.join(shared, "half", "left_semi").select("h1", "h2").distinct()


def near_earlier(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those places ``at`` of ``wanted`` (first occurrences of different lines) for which another one before them has a near line."""
    of_doc = wanted.groupBy(F.col("at.doc").alias("doc"), F.col("at.row").alias("row")).agg(F.collect_list("at.line_no").alias("numbers"))
    lines = written(
        docs.join(of_doc, docs.doc.eqNullSafe(of_doc.doc) & (docs.row == of_doc.row))
        .select(docs.doc, docs.row, _lines(F.col("text")).alias("all"), "numbers")
        .select("doc", "row", F.explode(F.expr("transform(array_distinct(numbers), i -> struct(i as line_no, all[i] as line))")).alias("l"))
        .select(F.struct("doc", "row", "l.line_no").alias("at"), _words(F.col("l.line")).alias("w"))
        .groupBy("at")
        .agg(F.first("w").alias("w"))  # of equal rows one
    )
    # lines are dealt by their place before their words become rows, as the windows need them
    hashed = lines.repartition("at").select("at", F.size("w").alias("n"), F.posexplode("w").alias("i", "word")).select(
        "at", "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved")
    )
    line = Window.partitionBy("at").orderBy("i")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("at")
    xor = lambda c, w: F.coalesce(F.expr(f"bit_xor({c})").over(w), F.lit(0))
    variants = hashed.select(
        "at",
        "i",
        F.col("n").alias("n"),
        xor("here", before).alias("left"),
        xor("moved", line.rowsBetween(Window.unboundedPreceding, 0)).bitwiseXOR(xor("moved", after)).alias("right"),
        xor("here", after).alias("whole"),
    ).select(
        "at",
        F.explode(
            F.when(
                F.col("i") == 0,
                F.array(
                    F.struct(F.col("left").bitwiseXOR(F.col("right")).alias("v"), (F.col("n") - 1).alias("m"), F.col("i").alias("i")),
                    F.struct(F.col("whole").alias("v"), F.col("n").alias("m"), F.lit(-1).alias("i")),
                ),
            ).otherwise(F.array(F.struct(F.col("left").bitwiseXOR(F.col("right")).alias("v"), (F.col("n") - 1).alias("m"), F.col("i").alias("i"))))
        ).alias("x"),
    ).select("at", "x.v", "x.m", "x.i")
    # only variants that two lines share; of each place of deletion (-1: none) the earliest line
    shared = written(variants.groupBy("v", "m").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("v", "m"))
    variants = written(variants.join(shared, ["v", "m"], "left_semi"))
    dropped(shared)
    earliest = variants.groupBy("v", "m", "i").agg(F.min("at").alias("other")).select("v", "m", F.col("i").alias("j"), "other")
    pairs = variants.join(earliest, ["v", "m"]).where("other < at and (i = j or i = -1 or j = -1)")
    links = pairs.groupBy("at").agg(F.min(F.struct("other", "i", "j")).alias("l")).select("at", "l.*")
    mine, theirs = lines.select("at", F.col("w").alias("a")), lines.select(F.col("at").alias("other"), F.col("w").alias("b"))
    cut = lambda w, i: F.when(F.col(i) < 0, F.col(w)).otherwise(_without(F.col(w), F.greatest(F.col(i), F.lit(0))))
    return links.join(mine, "at").join(theirs, "other").where(cut("a", "i") == cut("b", "j")).select("at")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 5, short_repeats: bool = False) -> DataFrame:
    """The rows of ``docs``; of their texts, lines that repeat earlier ones are gone; with n_lines and n_dropped.

    Order is by doc_id (null first), then by line. A line of n words goes if a line before it has the same words or differs by one word (replaced, put in or left out); the
    line before counts even where it goes itself. Lines of under ``min_words`` words are near to none; with
    ``short_repeats`` they go if a line before has the same words, else they are left alone. Blank lines stay. Rows that agree on doc_id and text count as one. A null text
    stays null with no lines; an empty one has one line. Further columns are kept; n_lines and n_dropped are
    replaced where the input has them.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text]).alias("rest"), F.col(doc_id).alias("doc"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))
    texts = keyed.where("text is not null").select("doc", "row", "text")
    lines = written(occurrences(texts, min_words, short_repeats))
    wanted = with_shared_end(lines).withColumn("wanted", F.lit(True))
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct(*AT)).alias("at"), F.max(F.struct(*AT)).alias("last"))
    # most lines are met once and near to none: they go no further
    first = written(first.join(wanted, ["h1", "h2"], "left").where("wanted or at <> last"))
    near = near_earlier(texts, first.where("wanted").select("at")).withColumn("near", F.lit(True))
    judged = first.join(near, "at", "left").where("near or at <> last").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near"))
    gone = (
        lines.select(F.struct(*AT).alias("here"), "h1", "h2")
        .join(judged, ["h1", "h2"])
        .where("near or here <> at")
        .groupBy(F.col("here.doc").alias("d"), F.col("here.row").alias("r"))
        .agg(F.collect_set("here.line_no").alias("gone"))
    )
    numbers = F.expr("array_except(sequence(0, size(lines) - 1), gone)")
    return (
        keyed.join(gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
        .withColumn("lines", _lines(F.col("text")))
        # by explode, as a caller's filter on text would else be moved below and split the text for each of its lines
        .withColumn("text", F.explode(F.array(F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(numbers, lambda i: F.get("lines", i)), "\n")))))
        .select(
            *[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`") for c in kept],
            F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
