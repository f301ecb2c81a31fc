"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots in order. The index is one table, written
once: each different vector with its order of pivots and the least of the ids that share it.
Pivots are posted in inverted files of (vector, place of the pivot in its order). A query looks
only into the files of its own nearest pivots and adds up by how little the places differ; that
ranks vectors by Spearman's footrule over the prefixes, with absent pivots at the full distance.
Vectors at least as near as the query's cut are reranked by exact inner products in double
precision. The cut is the footrule of the nearest ``share`` of a sample of at most ``SAMPLE``
vectors, so it depends on the query and on the table, not on how rows lie over tasks.

Pivots are chosen farthest-first from the same sample; every vector is indexed. Largest inner
product becomes least distance by one more coordinate, which levels all lengths to the greatest
one. Equal vectors are indexed once, so a vector that many rows share can't crowd out others.

Index and queries are two tables, cut into segments and blocks of a bounded size; a task holds
the inverted files of one segment and answers one block, and only the best leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, workdir

PIVOTS, PREFIX, SAMPLE = 512, 48, 4096
#: Different vectors of a segment of the index, and of a block of queries, on average at most.
SEGMENT, BLOCK = 8192, 8192


def usable(column: str) -> Column:
    """Whether an array of numbers can take part: not null, no null or non-finite component, not zero."""
    return F.expr(f"coalesce(size(`{column}`) > 0 and forall(`{column}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(`{column}`, x -> x <> 0), false)")


class Pivots:
    """Pivots in the space of one more coordinate; ``greatest`` is the greatest length of any vector."""

    def __init__(self, sample: np.ndarray, greatest: float, n: int = PIVOTS):
        self.greatest = greatest or 1.0
        x = self.level(sample)
        chosen = [0]
        far = ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < min(n, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        self.at = x[chosen]

    def level(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x / self.greatest
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return np.concatenate([x, more[:, None]], axis=1)

    def orders(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The numbers of the nearest pivots of each vector, nearest first."""
        if query:  # a query's length doesn't matter: it is put at the length of the others
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) * self.greatest
        near = self.level(x, query) @ self.at.T * 2 - (self.at**2).sum(axis=1)
        return np.argsort(-near, axis=1, kind="stable")[:, :PREFIX]


class Files:
    """Inverted files of a run of vectors, given their orders of pivots."""

    def __init__(self, order: np.ndarray, n_pivots: int):
        self.n, self.width = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.bounds = np.searchsorted(flat[by], np.arange(n_pivots + 1))
        self.vector, self.place = by // max(self.width, 1), by % max(self.width, 1)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """For each vector, the greatest possible distance from a query's order less its own: more is nearer."""
        spans = [slice(self.bounds[p], self.bounds[p + 1]) for p in order]
        vector = np.concatenate([self.vector[s] for s in spans])
        gain = np.concatenate([len(order) - np.abs(self.place[s] - k) for k, s in enumerate(spans)])
        return np.bincount(vector, gain, self.n)


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _ordered(shared):
    """Adds the order of pivots to (k1, k2, ids, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                order = shared.value.orders(_matrix(part.column(3)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(order.astype(np.int16)), pa.list_(pa.int16()))], names=["k1", "k2", "ids", "x", "places"])

    return run


def _cut(shared, share: float, least: int):
    """(k1, k2, x, order of pivots, cut) of queries: their cut is the footrule that a share of the sample reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sample = shared.value
        files = Files(pivots.orders(sample), len(pivots.at))
        m = min(len(sample), max(least, int(np.ceil(share * len(sample)))))
        for batch in batches:
            order = pivots.orders(_matrix(batch.column(2)), query=True)
            cut = [float(np.partition(files.footrule(o), len(sample) - m)[len(sample) - m]) for o in order]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order.astype(np.int16)), pa.list_(pa.int16())), pa.array(cut, pa.float64())], names=["k1", "k2", "x", "places", "cut"])

    return run


def _best(score: np.ndarray, ids: list[list[int]], at: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k best (score, id) of the candidates ``at``, ties to the lesser id; an id that repeats comes once."""
    top = min(len(at), 2 * k)
    while True:
        least = np.partition(score, len(at) - top)[len(at) - top]
        found: dict[int, float] = {}
        for s, v in zip(score[score >= least].tolist(), at[score >= least].tolist()):
            for i in ids[v]:
                found[i] = max(s, found.get(i, s))
        if len(found) >= k or top == len(at):
            return sorted(((s, i) for i, s in found.items()), key=lambda r: (-r[0], r[1]))[:k]
        top = min(len(at), 4 * top)


def _answered(n_pivots: int, k: int):
    """The k best of a segment of the index for every query of a block."""

    def run(index: pa.Table, block: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(index) and len(block):
            x, ids = _matrix(index.column("x")), index.column("ids").to_pylist()
            files = Files(_matrix(index.column("places"), np.int64), n_pivots)
            keys = zip(block.column("k1").to_pylist(), block.column("k2").to_pylist(), block.column("cut").to_pylist())
            for (k1, k2, cut), q, order in zip(keys, _matrix(block.column("x")), _matrix(block.column("places"), np.int64)):
                at = np.flatnonzero(files.footrule(order) >= cut)
                if len(at):
                    rows += [(k1, k2, i, s) for s, i in _best((x[at] * q).sum(axis=1), ids, at, k)]
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("k1", "k2", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, share: float = 0.25, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose ``id`` meets the condition ``queries``.

    Nearness is the inner product in double precision; ties go to the lesser id, and a query's own
    id is no candidate. Vectors that are null, zero, hold null or non-finite components, have
    another number of components than most, or have no id take no part. An id that repeats is ranked
    once, by its best vector; as a query it is answered for all its vectors together. Fewer candidates
    than k are all returned; an empty table gives no rows. Answers don't depend on partitions.
    """
    spark, folder = vectors.sparkSession, workdir(vectors.sparkSession)
    rows = vectors.filter(usable(vector_col) & F.col(f"`{id_col}`").isNotNull()).select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("x"))
    facts = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(F.expr("sqrt(aggregate(x, 0D, (a, v) -> a + v * v))")).alias("greatest")).orderBy(F.desc("n"), "dim").first()
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # 128 bits tell vectors apart; -0.0 counts as 0.0
    rows = rows.filter(F.size("x") == facts["dim"]).withColumn("x", F.expr("transform(x, v -> v + 0D)"))
    rows = rows.select("id", "x", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(7), "x").alias("k2"))
    one = Window.partitionBy("k1", "k2").orderBy("id")
    vector = rows.withColumn("turn", F.row_number().over(one)).filter("turn = 1").select("k1", "k2", "x")
    # of the ids that share a vector, only so many can ever be answers
    shared_by = rows.select("k1", "k2", "id").distinct().withColumn("turn", F.row_number().over(one)).filter(F.col("turn") <= k + 1).groupBy("k1", "k2").agg(F.collect_list("id").alias("ids"))
    distinct = materialize(vector.join(shared_by, ["k1", "k2"]).select("k1", "k2", "ids", "x"), f"{folder}/vectors")
    sample = np.array([r["x"] for r in distinct.select("x", "k1", "k2").orderBy("k1", "k2").limit(SAMPLE).collect()], np.float64)
    pivots = Pivots(sample, facts["greatest"])
    index = materialize(distinct.mapInArrow(_ordered(spark.sparkContext.broadcast(pivots)), "k1 long, k2 long, ids array<long>, x array<double>, places array<short>"), f"{folder}/index")
    asked = materialize(rows.filter(queries).select(F.col("id").alias("query_id"), "k1", "k2").distinct(), f"{folder}/asked")
    wanted = distinct.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "x")
    cut = wanted.mapInArrow(_cut(spark.sparkContext.broadcast((pivots, sample)), share, k + 1), "k1 long, k2 long, x array<double>, places array<short>, cut double")
    blocks = materialize(cut, f"{folder}/queries")
    segments, parts = -(-index.count() // SEGMENT), max(1, -(-blocks.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("i", F.pmod("k1", F.lit(segments)).cast("int")).withColumn("j", every(parts))
    right = blocks.withColumn("i", every(segments)).withColumn("j", F.pmod("k1", F.lit(parts)).cast("int"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_answered(len(pivots.at), k + 1), "k1 long, k2 long, vec_id long, score double")
    # an id counts once for a query's vector; the best k and one more, as the query itself may be among them
    best = found.repartition("k1", "k2").groupBy("k1", "k2", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
    few = best.withColumn("turn", order).filter(F.col("turn") <= k + 1).groupBy("k1", "k2").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    few = materialize(few, f"{folder}/found")
    # many queries may share a vector, so their lists come by a merge join, which adaptive plans split
    each = asked.join(few.hint("merge"), ["k1", "k2"]).select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score").filter("vec_id <> query_id")
    once = each.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
