"""Whitened embeddings: exact sums, a covariance computed tile by tile, one small eigendecomposition.

1. Every vector becomes whole numbers. Sums of each dimension are exact; Spark adds those of all tasks.
2. Dimensions are cut into column blocks, and pairs of column blocks are tiles. A task cuts its
   rows into row blocks and sends a column block of a row block to every tile it belongs to, as
   the shortest integers that hold it. The key of the shuffle is (row block, tile), so a group has
   two column blocks of at most ``ROWS`` rows whatever the size of the table. It is centred,
   multiplied, and its products are added to those of the other row blocks, on the map side first.
3. Only the finished covariance, whose size is that of the dimensions and not of the table,
   comes to the driver, which decomposes it.
4. A pass over the table adds up the covariance of the whitened values, the next one returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go

#: Rows of a row block, and the dimensions of a column block at most.
ROWS, WIDTH = 4096, 256
SCALE, SHIFT = 1024, 100_000
#: Entries of this size and above count as not finite: their whole numbers would lose digits.
LARGEST = 2.0**40


def _whole(batch: pa.RecordBatch, dims: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the rows of the batch that take part, and their whole numbers, a row each."""
    vectors = batch.column(1)
    if pa.types.is_large_list(vectors.type) or pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    lengths = np.diff(vectors.offsets.to_numpy())
    first = vectors.offsets.to_numpy()[:-1]
    values = vectors.values.cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)  # null entries come as NaN
    there = np.asarray(vectors.is_valid())
    out = {}
    for d in np.unique(lengths[there]).tolist() if dims is None else [dims]:
        rows = np.flatnonzero(there & (lengths == d))
        if not d or not len(rows):
            continue
        x = flat[first[rows][:, None] + np.arange(d)]
        good = (np.abs(x) < LARGEST).all(axis=1)  # false for NaN
        if good.any():
            out[d] = rows[good], np.floor(x[good] * SCALE).astype(np.int64) + SHIFT
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    n, sums = {}, {}
    for batch in batches:
        for d, (rows, x) in _whole(batch).items():
            n[d] = n.get(d, 0) + len(rows)
            sums[d] = sums.get(d, 0) + x.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([sums[d].tolist() for d in n], pa.list_(pa.int64()))], names=["dims", "n", "sums"])


def _column_blocks(dims: int) -> list[tuple[int, int]]:
    width = min(WIDTH, max(1, -(-dims // 2)))
    return [(a, min(dims, a + width)) for a in range(0, dims, width)]


def _dealt(dims: int, anchor: np.ndarray):
    """Column blocks of row blocks, each with the tiles that need it."""
    blocks = _column_blocks(dims)

    def cut(task: int, k: int, x: np.ndarray) -> pa.RecordBatch:
        x = x - anchor
        small = np.int16 if np.abs(x).max() < 2**15 else np.int32 if np.abs(x).max() < 2**31 else np.int64
        parts = [np.ascontiguousarray(x[:, a:b].astype(small)).tobytes() for a, b in blocks]
        rows = [(c, min(c, o), max(c, o)) for c in range(len(blocks)) for o in range(len(blocks))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task] * len(rows), pa.int32()), pa.array([k] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
                pa.array([r[0] for r in rows], pa.int32()), pa.array([np.dtype(small).itemsize] * len(rows), pa.int32()), pa.array([parts[r[0]] for r in rows], pa.binary()),
            ],
            names=["task", "row_block", "i", "j", "at", "bytes", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for _, x in _whole(batch, dims).values():
                held.append(x)
                n += len(x)
                if n >= ROWS:
                    x = np.concatenate(held)
                    for a in range(0, n - n % ROWS, ROWS):
                        yield cut(task, k, x[a : a + ROWS])
                        k += 1
                    held, n = [x[n - n % ROWS :]], n % ROWS
        if n:
            yield cut(task, k, np.concatenate(held))

    return run


def _multiplied(dims: int, off: np.ndarray):
    """Products of the two column blocks of a tile over one row block: a row for each row of the tile."""
    blocks = _column_blocks(dims)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        centred = {}
        for at, size, data in zip(*(table.column(c).to_pylist() for c in ("at", "bytes", "data"))):
            a, b = blocks[at]
            centred[at] = np.frombuffer(data, f"<i{size}").reshape(-1, b - a).astype(np.float64) - off[a:b]
        product = centred[i].T @ centred[j]
        a, c = blocks[i][0], blocks[j][0]
        return pa.table({"a": pa.array(range(a, a + len(product)), pa.int32()), "from": pa.array([c] * len(product), pa.int32()), "products": pa.array(product.tolist(), pa.list_(pa.float64()))})

    return run


def _whitened(dims: int, centre: np.ndarray, axes: np.ndarray):
    """axes: the components over the roots of their eigenvalues, a column each; NaN where there is no variance."""

    def of(x: np.ndarray) -> np.ndarray:
        return (x - centre) @ axes

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((axes.shape[1] + 1,) * 2)
        for batch in batches:
            for rows, x in _whole(batch, dims).values():
                w = np.column_stack([of(x), np.ones(len(rows))])
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "product"])

    return of, spread


def whiten(embeddings: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Each entry c becomes the whole number x = floor(1024 c) + 100000. Components are the unit
    eigenvectors of the covariance of all x-vectors (divisor n), numbered from 1 by falling
    eigenvalue e, their largest entry positive; at most ``components`` and at most the dimensions.
    ``deviation`` is the sum over the dimensions of (n x - S)**2, S their sums: exact, and null
    where it exceeds a long. ``whitened`` is x - S / n along the component over the root of e,
    ``explained`` e over the trace, ``identity_error`` the largest absolute entry of the covariance of the
    whitened values minus the identity.

    Null vectors, vectors with a null, NaN or infinite entry or one of 2**40 or more, and empty
    vectors take no part, nor do vectors of another length than the most frequent one (of two,
    the longer). Rows that repeat count as often as they stand there; null ids are kept. A
    component without variance (one vector, equal vectors, dependent dimensions) has a null
    ``whitened`` and no part in ``identity_error``, which is null where no component has any. Ties
    of eigenvalues leave the choice of axes to the decomposition. Other columns are not read; an empty table
    gives no rows.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(embeddings[id_col].alias("id"), embeddings[vector_col].alias("vector"))
    totals = rows.mapInArrow(_summed, "dims int, n long, sums array<long>").select("dims", "n", F.posexplode("sums").alias("at", "s")).groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = totals.groupBy("dims").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("sums")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not best:
        return spark.createDataFrame([], schema)
    dims, n, sums = best[0]["dims"], best[0]["n"], np.array([r["s"] for r in best[0]["sums"]], np.int64)
    anchor = sums // n
    off = (sums - anchor * n) / n  # what the mean has beyond the anchor
    dealt = rows.mapInArrow(_dealt(dims, anchor), "task int, row_block long, i int, j int, at int, bytes int, data binary")
    tiles = dealt.groupBy("task", "row_block", "i", "j").applyInArrow(_multiplied(dims, off), "a int, from int, products array<double>")
    entries = tiles.select("a", "from", F.posexplode("products").alias("b", "v")).groupBy("a", (F.col("from") + F.col("b")).alias("b")).agg(F.sum("v").alias("v"))
    cov = np.zeros((dims, dims))
    for a, b, v in entries.toLocalIterator():
        cov[a, b] = cov[b, a] = v / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    some = e > dims * np.finfo(float).eps * max(e[0], 0)
    explained = np.maximum(e, 0) / np.trace(cov) if some.any() else np.full(len(e), np.nan)
    axes = np.where(some, axes / np.sqrt(np.where(some, e, 1)), 0)
    of, spread = _whitened(dims, anchor + off, axes)
    error = None
    if some.any():
        product = rows.mapInArrow(spread, "at int, product double").groupBy("at").agg(F.sum("product").alias("product")).orderBy("at").collect()
        m = np.array([r["product"] for r in product]).reshape(len(e) + 1, len(e) + 1)
        mean = m[-1, :-1] / n
        off_identity = np.abs(m[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(e)))
        error = float(off_identity[np.ix_(some, some)].max())

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for batch in batches:
            for at, x in _whole(batch, dims).values():
                far = ((n * x.astype(np.float64) - sums) ** 2).sum(axis=1) > 2.0**62
                off = np.where(far[:, None], 0, x) * n - np.where(far[:, None], 0, sums)
                deviation = pa.array(np.repeat((off * off).sum(axis=1), k), mask=np.repeat(far, k))
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviation,
                        pa.array(of(x).ravel(), mask=~np.tile(some, m)), pa.array(np.tile(explained, m), mask=np.isnan(np.tile(explained, m))), pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(final, schema)
