"""Approximate nearest neighbours: low-dimensional stable projections indexed by kd-tree.

Vectors are projected to ``PROJECTED`` dimensions by a Gaussian (2-stable) matrix. The squared projected distance of
a vector at distance d from the query is d^2 times a chi-square variable of that many degrees of freedom. A kd-tree
gives a query's projected neighbours incrementally, nearest first; they are verified on the original vectors, until
the chi-square test holds: the next projected distance r is so large that a vector nearer than the k-th found would be
that far in projection with a probability of at most 1 - ``CONFIDENCE``.

Scale. The top of the kd-tree, at most ``CELLS`` cells, is fitted on a sample of at most ``SAMPLE`` rows; all rows are
indexed. Cells are dealt to shards of about ``SHARD`` vectors, by a hash of the row where a cell has more (many equal
vectors, say), and each shard is one row of an index table. A query goes to its own cell first, then, with the k-th
distance from there, to the cells that the test does not rule out. Queries travel in blocks of bounded size; an index
row is shuffled once a round however many blocks it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from cargolens.llm.shared import dropped, with_package, written

PROJECTED, LEAF, CONFIDENCE, SEED = 32, 32, 0.9, 5
SHARD, BLOCK, CELLS, SAMPLE = 8_000, 8_000, 256, 8_192
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def chi_square(p: float, degrees: int) -> float:
    """The p-quantile, by bisection on the regularised incomplete gamma function's series."""
    from math import exp, lgamma, log

    def below(x: float) -> float:
        a, x = degrees / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * exp(-x + a * log(x) - lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 50.0 + 10 * degrees
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class Tree:
    """A kd-tree of projected points: leaves of about ``LEAF`` points, each with its bounding box."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            part = points[at]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            half = len(at) // 2
            order = np.argpartition(part[:, axis], half)
            todo += [at[order[:half]], at[order[half:]]]
        self.leaves = leaves
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of each leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap**2).sum(1)


def matrix(size: int, projected: int = PROJECTED) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size, projected))


@dataclass
class Cells:
    """The top of the kd-tree over projected vectors: planes, and the box of each cell."""

    axis: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)  # next plane, or -1 less the number of the cell
    high: list[int] = field(default_factory=list)
    boxes: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    root: int = -1

    @classmethod
    def fit(cls, points: np.ndarray, n: int) -> Cells:
        """About ``n`` cells of equal shares of ``points``; fewer where points are equal."""
        cells = cls()

        def grow(part: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
            spread = part.max(0) - part.min(0) if len(part) > 1 else np.zeros(1)
            axis = int(np.argmax(spread))
            if n < 2 or spread[axis] == 0:
                cells.boxes.append((low, high))
                return -len(cells.boxes)
            at = float(np.median(part[:, axis]))
            below = part[:, axis] <= at
            if below.all():
                at = float(part[below & (part[:, axis] < at), axis].max())
                below = part[:, axis] <= at
            me = len(cells.axis)
            cells.axis.append(axis)
            cells.at.append(at)
            cells.low.append(0)
            cells.high.append(0)
            cut = lambda box: np.where(np.arange(len(box)) == axis, at, box)
            cells.low[me] = grow(part[below], n // 2, low, cut(high))
            cells.high[me] = grow(part[~below], n - n // 2, cut(low), high)
            return me

        size = points.shape[1]
        cells.root = grow(points, n, np.full(size, -np.inf), np.full(size, np.inf))
        return cells

    def of(self, points: np.ndarray) -> np.ndarray:
        """Number of each point's cell."""
        out, todo = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            below = points[rows, self.axis[node]] <= self.at[node]
            todo += [(self.low[node], rows[below]), (self.high[node], rows[~below])]
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point from each cell's box."""
        out = np.empty((len(points), len(self.boxes)))
        for i, (low, high) in enumerate(self.boxes):
            out[:, i] = (np.maximum(np.maximum(low - points, points - high), 0) ** 2).sum(1)
        return out


def search(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float = CONFIDENCE, projected: int = PROJECTED, bounds: np.ndarray | None = None
) -> tuple[list[tuple[int, int, float]], int]:
    """(query, id, distance) of at most k neighbours of each query among ``vectors``, its own id left out, and how many vectors were verified.

    ``bounds``: distances that k neighbours elsewhere are known to be within.
    """
    limit, plane = chi_square(confidence, projected), matrix(vectors.shape[1], projected)
    points, near = vectors @ plane, queries @ plane
    tree = Tree(points)
    found, verified = [], 0
    for q, vector, low, bound in zip(query_ids, queries, near, np.full(len(queries), np.inf) if bounds is None else bounds):
        box = tree.distances(low)
        order = np.argsort(box)
        waiting, far = np.zeros(0, np.int64), np.zeros(0)  # of opened leaves, by projected distance
        best_d, best_i, at, step = np.zeros(0), np.zeros(0, np.int64), 0, 8
        while True:
            kth = min(bound, best_d[-1]) if len(best_d) == k else bound
            stop = limit * kth**2
            # the nearest points that wait are next if no leaf that is not open may hold nearer ones
            edge = box[order[at]] if at < len(order) else np.inf
            n = min(32, int(np.searchsorted(far, min(edge, stop), "right")))
            if n == 0:
                if edge > stop or at >= len(order):
                    break
                rows = np.concatenate([tree.leaves[x] for x in order[at : at + step]])
                at, step = at + step, min(256, step * 2)
                far = np.concatenate([far, ((points[rows] - low) ** 2).sum(1)])
                waiting = np.concatenate([waiting, rows])
                sort = np.argsort(far, kind="stable")
                waiting, far = waiting[sort], far[sort]
                continue
            rows, waiting, far = waiting[:n], waiting[n:], far[n:]
            verified += n
            i = ids[rows]
            d = np.sqrt(((vectors[rows] - vector) ** 2).sum(1))
            other = i != q
            d, i = np.concatenate([best_d, d[other]]), np.concatenate([best_i, i[other]])
            keep = np.lexsort((i, d))[:k]
            best_d, best_i = d[keep], i[keep]
        found += [(q, int(i), float(d)) for i, d in zip(best_i, best_d)]
    return found, verified


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of a shard or a block: ids, vectors and bounds as bytes. Equal rows once; rows of one id with different vectors all stay."""
    if not rows["id"].is_unique:
        rows = rows[~pd.Series([(i, e.tobytes()) for i, e in zip(rows["id"], rows["e"])], index=rows.index).duplicated()]
    keys = {c: [rows[c].iloc[0]] for c in ("n", "cell", "sub")}
    return pd.DataFrame({**keys, "ids": [rows["id"].to_numpy(np.int64).tobytes()], "vectors": [np.stack(rows["e"]).astype(np.float64).tobytes()], "bounds": [rows["bound"].to_numpy(np.float64).tobytes()]})


PACKED = "n int, cell long, sub long, ids binary, vectors binary, bounds binary"


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", confidence: float = CONFIDENCE, projected: int = PROJECTED, shard: int = SHARD, block: int = BLOCK, verified: bool = False
) -> DataFrame:
    """Per query its k nearest found: query_id, rank (from 1), vec_id, score (Euclidean distance, double precision).

    ``queries`` has the columns of ``vectors``; other columns are not read. A query never finds rows with its own id.
    Ties go to the smaller id. Vectors that are null, all zero, of no components, or that hold a null or non-finite
    component take no part, nor do rows without an id; of rows that share an id, equal ones count once, and the id is
    found once, by its nearest vector. Only vectors of a query's own number of components are compared. Fewer than k
    candidates give fewer rows, an empty table none. With ``verified``, instead: one row with n_verified, the number of
    original vectors that were compared with queries.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        e = F.col("e")
        return (
            df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
            .where(e.isNotNull() & F.col("id").isNotNull() & (F.size(e) > 0))
            .where(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0))
            .withColumn("n", F.size(e))
        )

    base, asked = sound(vectors), sound(queries)
    limit = chi_square(confidence, projected)
    total = base.count()
    wanted = min(CELLS, -(-total // shard))
    tops: dict[int, Cells] = {}
    if wanted > 1:
        sample: dict[int, list] = {}
        share = min(1.0, SAMPLE / total)
        drawn = base.where(F.expr(f"pmod(xxhash64(id, 0), 1000000) < {int(share * 1_000_000) + 1}")).limit(2 * SAMPLE)
        for r in drawn.select("n", "e").collect():
            sample.setdefault(r.n, []).append(r.e)
        tops = {n: Cells.fit(np.array(e) @ matrix(n, projected), wanted) for n, e in sample.items()}
    held = spark.sparkContext.broadcast(tops)

    def placed(df: DataFrame, others: bool) -> DataFrame:
        """``df`` with its cell, or with the other cells that its bound does not rule out."""

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                n, cells = part.column("n").to_numpy(), [[0]] * len(part)
                for size in np.unique(n):
                    if top := held.value.get(int(size)):
                        rows = np.flatnonzero(n == size)
                        points = np.array(part.column("e").take(pa.array(rows)).to_pylist()) @ matrix(int(size), projected)
                        own = top.of(points)
                        if others:
                            reach = top.distances(points) <= limit * part.column("bound").to_numpy()[rows, None] ** 2
                            reach[np.arange(len(rows)), own] = False
                        for j, row in enumerate(rows):
                            cells[row] = np.flatnonzero(reach[j]).tolist() if others else [own[j]]
                    elif others:
                        for row in np.flatnonzero(n == size):
                            cells[row] = []
                yield part.append_column("cell", pa.array(cells, pa.list_(pa.int64())))

        return with_package(df).mapInArrow(batches, StructType([*df.schema.fields, StructField("cell", ArrayType(LongType()))])).withColumn("cell", F.explode("cell"))

    def dealt(df: DataFrame, key) -> DataFrame:
        """``df`` with the number of pieces of its cell, and the piece or all pieces."""
        return df.join(F.broadcast(pieces), ["n", "cell"]).withColumn("sub", key)

    infinite = F.lit(float("inf")).alias("bound")
    rows = written(placed(base.select("id", "e", "n", infinite), False))
    # a row for each number of components and cell
    pieces = written(rows.groupBy("n", "cell").agg(F.ceil(F.count("*") / shard).alias("subs")))
    index = written(with_package(dealt(rows, F.expr("pmod(xxhash64(id, e), subs)"))).groupBy("n", "cell", "sub").applyInPandas(_packed, PACKED))
    blocks = max(1, -(-asked.count() // block))

    def asks(df: DataFrame) -> DataFrame:
        every = dealt(df, F.explode(F.expr("sequence(0L, subs - 1)"))).withColumn("block", F.expr(f"pmod(xxhash64(id, 1), {blocks})"))
        return with_package(every).groupBy("n", "cell", "sub", "block").applyInPandas(_packed, PACKED).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})

    def searched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                take = lambda c: np.frombuffer(r[c], np.float64).reshape(-1, r["n"])  # noqa: E731, B023
                found, count = search(np.frombuffer(r["ids"], np.int64), take("vectors"), np.frombuffer(r["q_ids"], np.int64), take("q_vectors"), k, confidence, projected, np.frombuffer(r["bounds"], np.float64))
                found.append((None, None, float(count)))
                columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    def met(df: DataFrame) -> DataFrame:
        was = spark.conf.get(ARROW_ROWS)
        spark.conf.set(ARROW_ROWS, "4")  # rows are shards of megabytes
        try:
            return written(with_package(index.drop("bounds").join(asks(df), ["n", "cell", "sub"])).mapInArrow(searched, "query_id long, vec_id long, score double"))
        finally:
            spark.conf.set(ARROW_ROWS, was)

    def best(df: DataFrame) -> DataFrame:
        once = df.where("query_id is not null").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).where(F.col("rank") <= k)

    asked = asked.select("id", "e", "n", infinite)
    home = met(placed(asked, False))
    if tops:
        kth = best(home).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        bounded = asked.drop("bound").join(kth, "id", "left").select("id", "e", "n", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
        home = home.unionByName(met(placed(bounded, True)))
    dropped(rows, index, pieces)
    if verified:
        return home.where("query_id is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).cast("long").alias("n_verified"))
    return best(home).select("query_id", "rank", "vec_id", "score")
