"""Benchmark decontamination [native]: template canonicalisation and a hash join of template windows.

Words of documents and benchmark items are brought to templates: numbers become <num>, units after numbers <unit>,
capitalised words inside a sentence <name>; other words lose case and punctuation. Windows of template words are
joined by hash, compared word by word, and their slots must be consistent: over all windows of an instance of an item
(those at one offset from it), equal values of the item stand where the document has equal values, and different ones
where it has different ones. So a question with new numbers, names or units is found, while windows that only share
their placeholders, or that stand for contradicting values, are not. Windows with too few
words besides placeholders are joined by their words as they stand instead, values included, so short items and those
full of numbers are found word for word. The template of an item's first word depends on what a document has before
it ('What' is a name after a word or a comma), so the first window also stands with a placeholder in its place, which
only the same word fills.

Scale: texts are read once for the windows; hashes of windows are filtered against the benchmark's by a broadcast
of the hashes alone where they take at most ``BROADCAST_BYTES`` (counted first, as are the windows with their words for
the last join), else by a shuffled join; both give the same rows. Benchmark windows with the same hash are one row, so a frequent passage costs one match a
document. Matches grow with the documents, so the texts that have some are found by a shuffled join at every size:
it moves each text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import LOWER, UPPER, written

WINDOW, LITERALS, NEED = 8, 5, 5
BROADCAST_BYTES, HASH_BYTES, WORD_BYTES = 64 << 20, 64, 48
# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "ml cl l liter liters litre litres gallon gallons cup cups "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "kmh mph hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar k c f degree degrees percent "
    "usd eur gbp dollar dollars euro euros cent cents b kb mb gb tb byte bytes bit bits"
).split()
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"


def _spaced(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r<>]", " ")


def templates(text: Column) -> Column:
    """Template words of a text, word for word as ``plain`` has them; '' for words of punctuation only.

    In the patterns, what is rare is tested first, so that most characters cost one test.
    """
    t = _spaced(text)
    # names: capitalised after a word that ends no sentence
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}[\p{L}'-]*(?![^ ,;.:!?])", NAME)
    # numbers: digits with separators, signs and what is glued on
    t = F.regexp_replace(t, r"(?=[$€£+(\d-])(?<![^ ])[$€£+(-]*\d[^ ]*", NUM)
    t = F.regexp_replace(t, rf"{NUM} (?:{'|'.join(UNITS)})(?=[.,;:!?)]? |[.,;:!?)]?$)", f"{NUM} {UNIT}")
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{M}<> ]+", "")
    return F.split(t, " ")


def plain(text: Column) -> Column:
    return F.split(F.translate(_spaced(text), UPPER, LOWER), " ")


def exact(text: Column) -> Column:
    """Words as they stand, word for word as ``templates`` has them: without case and punctuation at their ends, apart from signs."""
    return F.split(F.regexp_replace(F.lower(_spaced(text)), r"(?<![^ ])[^\p{L}\p{M}\p{N} $€£+-]+|[^\p{L}\p{M}\p{N} %°]+(?![^ ])", ""), " ")


def _windows(lengths: list[tuple[str, int]]) -> str:
    """Hashes and places of windows of word hashes, all (column, length). Words are got one by one: a slice costs a whole text each."""
    words = lambda h, n: ", ".join(f"get({h}, i + {k})" for k in range(n))
    parts = [f"transform(if(size({h}) >= {n}, sequence(0, size({h}) - {n}), array()), i -> struct(i as i, {n} as n, {'true' if h == 'e' else 'false'} as exact, xxhash64({words(h, n)}) as hash))" for h, n in lengths]
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def _kept(df: DataFrame, text: str) -> DataFrame:
    """Words with a template: ``words`` of structs (t, p, e)."""
    return df.withColumn("words", F.filter(F.arrays_zip(templates(F.col(text)).alias("t"), plain(F.col(text)).alias("p"), exact(F.col(text)).alias("e")), lambda w: w["t"] != ""))


def _slots(words: str) -> str:
    return f"transform(filter({words}, w -> w.t like '<%'), w -> w.p)"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, literals: int = LITERALS, need: int = NEED) -> DataFrame:
    """Pairs (doc_id, item_id, n_windows): the item's windows that the document has, with consistent slots.

    Windows at one offset from the item are one instance of it; where their slots contradict each other, only windows
    without slots count.

    A document has an item if at least ``need`` different windows of the item (all, if it has fewer) are met;
    with the defaults that is a passage of 12 words. A window is ``window`` template words, items of fewer words are
    one window. Where fewer than ``literals`` of its words are words rather than placeholders, a window is met only
    word for word, and an item that has others too is also found by ``need`` (or all) of the others. So an item of
    one common word is met in each text that has the word. Null and empty texts have no windows; rows with the same doc_id count as one document, null being one
    of them; item rows with the same item_id as one item, items without an id are left out. Empty tables give no pairs;
    other columns of either table are not read. Texts are read whole, however long.
    """
    spark = docs.sparkSession
    items = _kept(benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "text").select("item_id", "words", F.expr(f"least(size(words), {window})").alias("n"))
    # the first word with the templates that it may have in a document
    first = lambda t: f"concat(array(named_struct('t', '{t}', 'p', x.words[0].p, 'e', x.words[0].e)), slice(x.words, 2, n - 1))"
    stand = f"if(x.i = 0 and not exact and not x.words[0].t like '<%', array(x.words, {first(NAME)}, {first(UNIT)}), array(x.words))"
    pieces = (
        items.where("n > 0")
        .select("item_id", F.explode(F.expr("transform(sequence(0, size(words) - n), i -> struct(i as i, slice(words, i + 1, n) as words))")).alias("x"), "n")
        .withColumn("exact", F.expr(f"size(filter(x.words, w -> not w.t like '<%')) < {literals}"))
        .select("item_id", F.col("x.i").alias("j"), "n", "exact", F.posexplode(F.expr(stand)).alias("variant", "w"))
        .withColumns({"fixed": F.col("variant") > 0, "template": F.expr("transform(w, w -> if(exact, w.e, w.t))"), "values": F.expr(f"if(exact, array(), {_slots('w')})")})
        .select("item_id", "j", "n", "exact", "fixed", F.expr("xxhash64(transform(template, w -> xxhash64(w)))").alias("hash"), "template", "values")
    )
    pieces = written(pieces)
    # at most two kinds of each length up to ``window``; in memory a word takes its bytes and WORD_BYTES, a row HASH_BYTES
    words = sum((F.length(F.array_join(c, "")) + WORD_BYTES * F.size(c)) for c in ("template", "values"))
    n_pieces, kinds, n_bytes = pieces.agg(F.count("*"), F.collect_set(F.struct(F.when(F.col("exact"), "e").otherwise("h"), "n")), F.coalesce(F.sum(words + 3 * HASH_BYTES), F.lit(0))).first()
    lengths = sorted(tuple(x) for x in kinds) or [("h", window)]
    hashes = pieces.select("hash", "n", "exact").distinct()
    hashes = F.broadcast(hashes) if n_pieces * HASH_BYTES <= BROADCAST_BYTES else hashes
    # windows first, without the words, so that rows stay small; then the words of documents with a hit
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    if any(h == "e" for h, _ in lengths):
        hashed = _kept(base, "text").select("doc_id", "row", F.expr("transform(words, w -> xxhash64(w.t))").alias("h"), F.expr("transform(words, w -> xxhash64(w.e))").alias("e"))
    else:
        hashed = base.select("doc_id", "row", F.array_remove(templates(F.col("text")), "").alias("t")).select("doc_id", "row", F.expr("transform(t, t -> xxhash64(t))").alias("h"))
    hits = written(
        hashed
        .select("doc_id", "row", F.explode(F.expr(_windows(lengths))).alias("x"))
        .join(hashes.select(F.col("hash").alias("b_hash"), F.col("n").alias("b_n"), F.col("exact").alias("b_exact")), (F.col("x.hash") == F.col("b_hash")) & (F.col("x.n") == F.col("b_n")) & (F.col("x.exact") == F.col("b_exact")))
        .groupBy(F.col("doc_id").alias("d"), F.col("row").alias("g"))
        .agg(F.collect_set("x").alias("xs"))
    )
    found = (
        _kept(base.join(hits.hint("merge"), (F.col("row") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d"))), "text")
        .select("doc_id", "row", F.explode(F.expr("transform(xs, x -> struct(x.i as i, x.hash as hash, x.n as n, x.exact as exact, transform(sequence(0, x.n - 1), k -> get(words, x.i + k)) as w))")).alias("x"))
        .select("doc_id", "row", "x.*")
        .select("doc_id", "row", "i", "hash", "n", "exact", F.expr("transform(w, w -> if(exact, w.e, w.t))").alias("template"), F.expr(f"if(exact, array(), {_slots('w')})").alias("mine"))
        .distinct()
    )
    steady = "size(array_distinct(slots)) = size(array_distinct(slots.values))"
    consistent = f"{steady} and size(array_distinct(slots)) = size(array_distinct(slots.mine))"
    grouped = pieces.groupBy("hash", "n", "exact", "fixed", "template", "values").agg(F.collect_list(F.struct("item_id", "j")).alias("where"))
    met = (
        found.join(F.broadcast(grouped) if n_bytes <= BROADCAST_BYTES else grouped, ["hash", "n", "exact", "template"])
        .withColumn("slots", F.arrays_zip("mine", "values"))
        .where(f"size(values) = 0 or (not fixed or mine[0] = values[0]) and ({consistent})")
        .select("doc_id", "row", "i", "exact", "slots", F.explode("where").alias("x"))
        .groupBy("doc_id", "row", F.col("x.item_id").alias("item_id"), (F.col("i") - F.col("x.j")).alias("offset"))
        .agg(F.collect_set(F.struct("x.j", "exact", (F.size("slots") == 0).alias("plain"))).alias("windows"), F.flatten(F.collect_set("slots")).alias("slots"))
        .select("doc_id", "item_id", F.explode(F.expr(f"filter(windows, w -> w.plain or {steady})")).alias("w"))
        .select("doc_id", "item_id", "w.j", "w.exact")
        .distinct()
        .groupBy("doc_id", "item_id")
        .agg(F.count_distinct("j").alias("n_windows"), F.count_if(~F.col("exact")).alias("by_template"))
    )
    counted = pieces.select("item_id", "j", "exact").distinct().groupBy("item_id").agg(F.count_distinct("j").alias("of_all"), F.count_if(~F.col("exact")).alias("of_templates"))
    enough = f"n_windows >= least(of_all, {need}) or by_template >= least(of_templates, {need}) and of_templates > 0"
    return met.join(counted, "item_id").where(enough).select("doc_id", "item_id", "n_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that have no item of ``benchmark`` (see ``find_benchmark``), all columns, in full."""
    hit = find_benchmark(docs, benchmark, doc_id, **options).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, docs[doc_id].eqNullSafe(hit.hit_id), "left_anti")
