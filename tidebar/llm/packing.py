"""Packing token pieces into sequences: large-item matching, then best fit.

Pieces of one length are alike, so the plan is made on the number of pieces of each length, at
most ``capacity`` numbers whatever the size of the corpus:

1. Pieces above a third of the capacity can stand at most two to a sequence (three would not
   fit, or only just). From the longest down, each is matched with the longest other such piece
   that still fits beside it.
2. Shorter pieces, from the longest down, go to the fullest sequence they fit in (best fit), or
   open a new one.

The plan lists groups of equally filled sequences. Each piece then finds its sequence and offset
from its rank among the pieces of its length, which needs no sort of the corpus: tasks number
their own pieces by length, and the counts of the tasks, summed up, give each task its start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sliced, workdir
from .tokens import encoder, with_end


@dataclass
class Group:
    """``count`` sequences, each filled by ``items`` in order: (length, how many of it)."""

    count: int
    items: list[tuple[int, int]]

    def gap(self, capacity: int) -> int:
        return capacity - sum(a * b for a, b in self.items)


def plan(counts: dict[int, int], capacity: int) -> list[Group]:
    """Groups of sequences that hold ``counts[length]`` pieces of each length from 1 to ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    by_gap: dict[int, list[Group]] = {}

    def put(count: int, items: list[tuple[int, int]]) -> None:
        if count:
            g = Group(count, items)
            by_gap.setdefault(g.gap(capacity), []).append(g)

    for n in large:
        while left[n]:
            mate = next((m for m in large if m + n <= capacity and (left[m] if m != n else left[n] - 1) > 0), None)
            if mate is None:
                put(left[n], [(n, 1)])
                left[n] = 0
            elif mate == n:
                put(left[n] // 2, [(n, 2)])
                left[n] %= 2
            else:
                k = min(left[n], left[mate])
                put(k, [(n, 1), (mate, 1)])
                left[n] -= k
                left[mate] -= k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g in by_gap if g >= n), default=None)
            if gap is None:
                each = min(capacity // n, left[n])
                put(left[n] // each, [(n, each)])
                left[n] %= each
                continue
            group = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
            each = min(gap // n, left[n])
            used = min(group.count, left[n] // each)
            put(used, [*group.items, (n, each)])
            put(group.count - used, group.items)
            left[n] -= used * each
    return [g for gap in sorted(by_gap) for g in by_gap[gap]]


def places(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: first rank, first sequence, pieces to a sequence, offset of the first.

    Sorted by length, then rank. A piece of rank r in a run stands in sequence
    ``sequence + (r - rank) // each`` at ``offset + (r - rank) % each * length``.
    """
    rows, next_rank, sequence = [], {}, 0
    for g in groups:
        offset = 0
        for n, each in g.items:
            rows.append((n, next_rank.get(n, 0), sequence, each, offset))
            next_rank[n] = next_rank.get(n, 0) + each * g.count
            offset += n * each
        sequence += g.count
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), cols))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if they fit, else full pieces behind a first one that may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, turn long"


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, texts in sliced(batches, "text"):
            ids, counts = with_end(*words.encode(texts), end_id)
            ids, rows = ids.astype("<u4"), []
            for doc, begin, n in zip(batch.column(0).to_pylist(), (np.cumsum(counts) - counts).tolist(), counts.tolist()):
                for k, (start, length) in enumerate(cut(n, capacity)):
                    at = begin + start
                    rows.append((doc, k, start, length, zlib.crc32(ids[at : at + length].tobytes()), task, int(seen[length])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=[x.split()[0] for x in _PIECE.split(", ")])

    return run


_ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents, each closed by ``end_id``, into as few sequences of ``capacity`` ids as the method can.

    Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only
    documents above ``capacity`` are cut. Null texts count as empty and give a piece of one id;
    rows that repeat are packed each for itself; null ids stay null; other columns are not read.
    An empty table gives no rows.
    """
    spark, folder = docs.sparkSession, workdir(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_pieces(tokenizer, end_id, capacity), _PIECE)
    pieces = materialize(rows, f"{folder}/pieces")
    # a row for each task and length, and in all at most `capacity` rows for the driver
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_task.select("task", "length", before.alias("first"))
    totals = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(totals, capacity)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        span = int(t["rank"].max(initial=0)) + 1
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            # runs are sorted by (length, rank), so one search in one number finds the run of a piece
            at = np.searchsorted(t["length"] * span + t["rank"], length * span + np.minimum(rank, span - 1), side="right") - 1
            nth = rank - t["rank"][at]
            sequence = t["sequence"][at] + nth // t["each"][at]
            offset = t["offset"][at] + nth % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(starts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("turn")).alias("rank"))
    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
