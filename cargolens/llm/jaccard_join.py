"""N-gram Jaccard join: universe partition and pigeonhole, verified exactly.

A document's set holds hashes of its distinct five-word shingles. Two sets of sizes a and b with a Jaccard
similarity of 0.8 differ in at most H = floor((a + b) / 9) elements. Per size band the universe of hashes is cut
into segments of 1.5 to 3 elements of a set; two similar sets differ in at most H of them.

Allocation by cost. A segment's cost is the number of sets that have the same one, counted over all texts. A set of E
segments leaves out its E - H - 1 most expensive ones and gives the others as keys: the cheapest segment that two
similar sets share has at most H cheaper ones in either, so both give it. Segments of one set only meet nothing;
a set with more than H of those is similar to no other and goes no further, which is so for most texts. Sets of 4 to
8 elements take one segment with its one-deletion neighbourhood, as H is 1: two of them that are not equal are similar
only if one is the other with one element more, so one-deletion keys of 5 to 8 elements meet whole sets of one element
less, never each other. A whole set is unique, so a deletion key that many texts share costs one link a text. Larger
sets (and 8 elements with 9 and 10) get no neighbourhood: a segment costs one key, a neighbourhood one key an element.

Scale: equal sets are one class from the start. The keys, about one for two words, are the largest shuffles: they are
counted with partial counts in each task, then joined with the counts of those that several sets have. Both sides of
that join, and of the joins with centres of stars, are tables, so that adaptive execution can split a segment of a
third of all texts over tasks; no key is gathered. A group of at most ``GROUP`` texts is paired. A larger one gives a
star, its members with its first one, then a second star between those that the links found so far leave apart. What
is left, groups with members that are still apart, is joined by ``_leftover``: elements of one member only are counted
and taken off, what remains equal is one class, and only different classes are compared. Components are found by
alternating large-star and small-star steps on tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.shared import dropped, with_package, written

WIDTH = 5
GROUP, STARS, BLOCK = 8, 2, 1500
#: Rows of ids and digests that are broadcast at most, about 100 MB in memory; more of them are joined by shuffle.
BROADCAST_ROWS = 1_000_000
CHUNK = 4 << 20
KEY = np.uint64((1 << 48) - 1)

_random = np.random.default_rng(20)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _random.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_sets(raw: list[bytes]) -> list[np.ndarray]:
    joined = b"\n".join(raw)
    a = np.frombuffer(joined, np.uint8)
    word = ~_SPACE[a]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in raw]
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    offset = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    words = mix(np.add.reduceat(_BYTE[a[word]] * _powers(int(lengths.max()))[offset], begins) ^ lengths.astype(np.uint64))
    text_starts = np.cumsum([0, *[len(r) + 1 for r in raw]])
    bounds = np.searchsorted(starts, text_starts)
    if len(words) >= WIDTH:
        shingles = np.zeros(len(words) - WIDTH + 1, np.uint64)
        for i in range(WIDTH):
            shingles += words[i : len(shingles) + i] * _PLACE[i]
        shingles = mix(shingles)
    out = []
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high - low >= WIDTH:
            out.append(np.unique(shingles[low : high - WIDTH + 1]))
        elif high > low:
            out.append(mix((words[low:high] * _PLACE[: high - low]).sum(keepdims=True) + np.uint64(high - low)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; none for a null text and one without words."""
    out, group, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        group.append(raw)
        size += len(raw)
        if size > CHUNK:
            out += _hash_sets(group)
            group, size = [], 0
    return out + (_hash_sets(group) if group else [])


def identity(s: np.ndarray) -> int:
    """64 bits for a whole set."""
    if not len(s):
        return 0
    return int(mix((s.sum(keepdims=True) ^ mix(np.array([len(s)], np.uint64))) + np.bitwise_xor.reduce(mix(s + _STEP)))[0].astype(np.int64))


def segments(s: np.ndarray, band: int) -> np.ndarray:
    """Hashes of the non-empty segments of a set in the order of segments, for sizes from 2**band to 2 * 2**band."""
    m = np.uint64(max(64, (2 << band) // 3))
    at = ((s >> np.uint64(32)) * m) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    content = np.add.reduceat(mix(s), first)
    # fewer bits shuffle less; keys that meet by chance only give pairs that do not verify
    return mix(content + at[first] * _STEP + np.uint64(band << 40)) & KEY


def bands(n: int) -> list[tuple[int, int]]:
    """(band, H) in which a set of n > 7 elements gives keys: its own, and the one below where partners may lie there."""
    own = n.bit_length() - 1
    found = [(own, min(n // 4, (n + (2 << own) - 1) // 9))]
    if own > 3 and -(-4 * n // 5) < 1 << own:
        found.append((own - 1, (n + (1 << own) - 1) // 9))
    return found


def small_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of a whole set of 4 to 7 elements, and the keys of a set of 5 to 8 with one element deleted."""
    n, none = len(s), np.zeros(0, np.uint64)
    mixed, two = mix(s), np.uint64(2)
    whole = mixed.sum(keepdims=True)
    return (mix(whole * two + np.uint64(n)) if 4 <= n <= 7 else none), (mix((whole - mixed) * two + np.uint64(n - 1)) if 5 <= n <= 8 else none)


def keys_of(s: np.ndarray, band: int, h: int) -> tuple[np.ndarray, int]:
    """All segments of a set in a band, and how many of them it may leave out."""
    keys = segments(s, band)
    if len(keys) <= h:
        # sets of so few segments may be similar without a common one; they meet here
        keys = np.append(keys, mix(np.array([band], np.uint64) + np.uint64(5)) & KEY)
    return keys, max(0, len(keys) - h - 1)


def _chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in parts:
        for at in range(0, max(1, len(part)), 512):
            piece = part.slice(at, 512)
            yield piece, shingle_sets(piece.column("text").to_pylist())


LONGS = pa.list_(pa.int64())


def _identified(docs: DataFrame) -> DataFrame:
    """doc, digest, n, id, whole, less of each row."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in _chunks(parts):
            small = [[x.view(np.int64) for x in small_keys(s)] for s in sets]
            columns = [pa.array(map(len, sets), pa.int64()), pa.array(map(identity, sets), pa.int64()), *(pa.array([x[i] for x in small], LONGS) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([piece.column("doc"), piece.column("digest"), *columns], ["doc", "digest", "n", "id", "whole", "less"])

    return with_package(docs).mapInArrow(batches, f"doc {docs.schema['doc'].dataType.simpleString()}, digest long, n long, id long, whole array<bigint>, less array<bigint>")


def _segmented(docs: DataFrame) -> DataFrame:
    """id, tag (how many keys may be left out, times 64, plus the band) and keys of sets of over 7 elements; equal sets of a task once."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _chunks(parts):
            ids, tags, keys = [], [], []
            for s in sets:
                if len(s) < 8 or (i := identity(s)) in seen:
                    continue
                seen.add(i)
                for band, h in bands(len(s)):
                    k, spare = keys_of(s, band, h)
                    ids.append(i)
                    tags.append(spare * 64 + band)
                    keys.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(keys, LONGS)], ["id", "tag", "keys"])

    return with_package(docs.select("text")).mapInArrow(batches, "id long, tag long, keys array<bigint>")


def _probes(docs: DataFrame) -> DataFrame:
    """(id, key, df), a table: the segments that sets do not leave out, as far as several sets have them; df is their cost."""
    # equal sets of several tasks become one before their keys are counted
    parts = written(_segmented(docs).dropDuplicates(["id", "tag"]))
    keys = parts.select("id", "tag", F.explode("keys").alias("key"))
    cost = written(keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    rank = F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.desc("df"), F.desc("key")))
    probes = written(keys.join(cost, "key").withColumn("rank", rank).where("rank > tag div 64").select("id", "key", "df"))
    dropped(parts, cost)
    return probes


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, short, set) of the sets ``wanted`` (id, doc, digest), read from one text each."""
    wanted = wanted.select("id", F.col("doc").alias("d"), F.col("digest").alias("g"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, (F.col("digest") == F.col("g")) & F.col("doc").eqNullSafe(F.col("d"))).select("id", "text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, len(part), 512):
                piece = part.slice(at, 512)
                sets = shingle_sets(piece.column("text").to_pylist())
                columns = [pa.array(map(len, sets), pa.int64()), pa.array([short(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *columns], ["id", "n", "short", "set"])

    return with_package(texts).mapInArrow(batches, "id long, n long, short binary, set binary")


def short(s: np.ndarray) -> np.ndarray:
    """The elements of a quarter of the universe in 16 bits each. Two sets differ in at least as many elements as their short forms."""
    return np.unique((s[(s & np.uint64(3)) == 0] >> np.uint64(48)).astype(np.uint16))


def _possible(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose short forms differ in no more elements than linked sets may."""
    for part in parts:
        keep = []
        for x, y, m, n in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), part.column("m").to_pylist(), part.column("n").to_pylist()):
            keep.append(5 * min(m, n) >= 4 * max(m, n) and len(np.setxor1d(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), assume_unique=True)) <= (m + n) // 9)
        yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        keep = []
        for x, y in zip(part.column("x"), part.column("y")):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= 80 * (len(x) + len(y) - common))
        yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _unpacked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        elements = [np.frombuffer(x, np.int64) for x in part.column("set").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(elements, LONGS)], ["id", "elements"])


def apart(cores: list[np.ndarray]) -> np.ndarray:
    """Number of elements in which each two of the sets differ; at most 2 * ``BLOCK`` sets."""
    n, size = len(cores), np.array([len(c) for c in cores], np.int64)
    token = np.unique(np.concatenate(cores), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    common = np.zeros((n, n), np.float32)
    for low in range(0, int(token[-1]) + 1, 2048):
        a, b = np.searchsorted(token, [low, low + 2048])
        part = np.zeros((n, 2048), np.float32)
        part[owner[a:b], token[a:b] - low] = 1
        common += part @ part.T
    return size[:, None] + size - 2 * common.astype(np.int64)


def _nearest_class(rows: pd.DataFrame) -> pd.DataFrame:
    """Per class (id of its first member, u, core): links to other classes' first members, and the one that links most.

    A member of class i with u elements of its own links to the first member of class j where u <= most.
    """
    rows = rows.drop_duplicates("id")
    ids, u, cores = rows["id"].to_numpy(), rows["u"].to_numpy(), [np.asarray(c, np.int64) for c in rows["core"]]
    k, d, found = np.array([len(c) for c in cores], np.int64), apart(cores), []
    root = np.arange(len(ids))
    for i in range(len(ids)):
        most = (k[i] + k - 9 * d[i]) // 8 - u
        most[i] = -1
        j = int(most.argmax())
        if most[j] >= u[i]:
            found.append((ids[i], ids[j], most[j], True))
        near = np.flatnonzero(most >= u[i])
        for j in near[root[near] != root[i]]:
            if root[j] != root[i]:
                found.append((ids[i], ids[j], most[j], False))
                root[root == root[j]] = root[i]
    return pd.DataFrame(found, columns=["a", "b", "most", "best"]).astype({"a": "int64", "b": "int64", "most": "int64", "best": bool})


def _leftover(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked sets that have a key of ``members`` (key, id) in common.

    u counts the elements of a set that no other member has, its core is the rest. With cores that differ in d elements,
    two sets link where 8 (u + u') + 9 d <= |core| + |core'|. So of the sets of one core the one of the smallest u has
    all links that another has; each other one needs one link at most, to it or to that of another core.
    """
    ids = members.select("id").distinct()
    flat = with_package(sets.join(ids, "id").select("id", "set")).mapInArrow(_unpacked, "id long, elements array<bigint>").select("id", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    common = flat.groupBy("e").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("e")
    gathered = flat.join(common, "e", "left_semi").groupBy("id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("e")).alias("core"))
    cores = written(gathered.select("id", (F.col("n") - F.size("core")).alias("u"), "core", F.size("core").alias("k"), F.xxhash64("core").alias("c1"), F.xxhash64(F.lit(1), "core").alias("c2")))
    first = cores.groupBy("c1", "c2").agg(F.min(F.struct("u", "id")).alias("first")).select("c1", "c2", F.col("first.u").alias("least"), F.col("first.id").alias("first"))
    of_class = written(cores.select("id", "u", "k", "c1", "c2").join(first, ["c1", "c2"]))
    inside = of_class.where("id <> first and 8 * (u + least) <= 2 * k").select(F.col("id").alias("a"), F.col("first").alias("b"))
    keyed = members.join(of_class.select("id", "first"), "id").select("key", F.col("first").alias("id")).distinct()
    weight = keyed.groupBy("id").agg(F.count("*").alias("w"))
    centres = keyed.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", "id")).alias("c")).select("key", F.col("c.id").alias("centre"))
    family = keyed.join(centres, "key").select("centre", "id").distinct()
    sizes = family.groupBy("centre").agg(F.count("*").alias("many")).where("many > 1")
    placed = family.join(sizes, "centre").withColumn("blocks", F.ceil(F.col("many") / BLOCK)).withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    pairs = placed.select("centre", "id", F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, block) as low, greatest(o, block) as high))")).alias("p"))
    blocks = pairs.select("centre", "p.low", "p.high", "id").join(cores.select("id", "u", "core"), "id")
    across = written(with_package(blocks).groupBy("centre", "low", "high").applyInPandas(_nearest_class, "a long, b long, most long, best boolean"))
    best = across.where("best").groupBy("a").agg(F.max(F.struct("most", "b")).alias("x")).select(F.col("a").alias("first"), "x.most", "x.b")
    outside = of_class.where("id <> first and 8 * (u + least) > 2 * k").join(best, "first").where("u <= most").select(F.col("id").alias("a"), "b")
    return inside.unionByName(across.select("a", "b")).unionByName(outside)


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) by alternating large-star and small-star; root is the smallest node of the component."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, edges = edges, written(small)
        dropped(before)
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


class _Links:
    """Components of the sets by the links that are verified so far."""

    def __init__(self, sets: DataFrame):
        self.sets, self.roots = sets, None

    def _sides(self, pairs: DataFrame, column: str) -> DataFrame:
        side = lambda name, value, n: self.sets.select(F.col("id").alias(name), F.col(column).alias(value), F.col("n").alias(n))
        return pairs.join(side("a", "x", "m"), "a").join(side("b", "y", "n"), "b")

    def rooted(self, df: DataFrame, column: str = "id", name: str = "root") -> DataFrame:
        """``df`` with the component of a column."""
        if self.roots is None:
            return df.withColumn(name, F.col(column))
        roots = self.roots.select(F.col("node").alias(column), F.col("root").alias(f"__{name}"))
        return df.join(roots, column, "left").withColumn(name, F.coalesce(f"__{name}", column)).drop(f"__{name}")

    def merge(self, links: DataFrame) -> None:
        if self.roots is not None:
            links = links.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.roots = components(links)

    def verify(self, pairs: DataFrame) -> None:
        """Whole sets are shipped for one pair a set first; then for the pairs whose ends have not met yet, so that a group
        of copies costs its size, not its square."""
        possible = written(with_package(self._sides(pairs, "short")).mapInArrow(_possible, "a long, b long"))
        linked = lambda p: with_package(self._sides(p, "set")).mapInArrow(_linked, "a long, b long")
        self.merge(linked(possible.groupBy("b").agg(F.min("a").alias("a"))))
        rest = written(self.rooted(self.rooted(possible, "a", "root_a"), "b", "root_b").where("root_a <> root_b").select("a", "b"))
        if not rest.isEmpty():
            self.merge(linked(rest))
        dropped(possible, rest)


def join_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included).

    Words are runs of anything but white space, A-Z in lower case; a text of one to four words is one shingle. Texts
    link where the Jaccard similarity of their sets is at least 0.8; texts with the same set are linked. A text that
    is null or has no words has no shingles and links to nothing: its component is its own doc_id. Rows that share a
    doc_id count as separate documents; a null doc_id is never the smallest, unless it is the only one of its component.
    Other columns are not read. Very long texts are taken whole; a set's elements are held by one task at a time.
    """
    base = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = written(_identified(base))
    classes = rows.where("n > 0").groupBy("id").agg(F.min("doc").alias("least"), F.min(F.struct("doc", "digest")).alias("at"))
    classes = written(classes.select("id", "least", "at.doc", "at.digest"))
    probes = _probes(base)
    groups = probes.where(F.col("df") <= GROUP).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("g")).where("size(g) > 1")
    pairs = groups.select(F.explode(F.expr("flatten(transform(g, (x, i) -> transform(slice(g, i + 2, size(g)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    large = probes.where(F.col("df") > GROUP).select("key", "id")
    centres = written(large.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a"))
    stars = large.join(centres, "key").where("id <> a").select("a", F.col("id").alias("b"))
    small = lambda column: rows.select("id", F.explode(column).alias("key")).distinct()
    one_more = small("less").join(small("whole").withColumnRenamed("id", "other"), "key").where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    pairs = written(pairs.unionByName(stars).unionByName(one_more).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(_sets_of(base, classes.join(wanted, "id", "left_semi")))
    links = _Links(sets)
    links.verify(pairs)
    dropped(pairs, centres)

    def mixed() -> DataFrame:
        """key, id, root, first: members of large groups that are still apart, and one root of each group."""
        placed = links.rooted(large)
        several = written(placed.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last"))
        out = written(placed.join(several, "key"))
        dropped(several)
        return out

    left = mixed()
    for _ in range(STARS - 1):
        if left.isEmpty():
            break
        second = written(left.where("root = last").groupBy("key").agg(F.min("id").alias("c")))
        links.verify(left.join(second, "key").where("root <> last").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct())
        dropped(left, second)
        left = mixed()
    if not left.isEmpty():
        links.merge(_leftover(left.select("key", "id"), sets))
    dropped(probes, left, sets)
    least = links.rooted(classes.select("id", "least"))
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "component_id")
    return rows.select("doc", "n", F.when(F.col("n") > 0, F.col("id")).alias("id")).join(named, "id", "left").select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
