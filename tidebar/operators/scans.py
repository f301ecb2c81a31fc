"""Scans over long ordered keys in blocks: what holds before each row, without a task for a whole key.

Rows of a key are cut into blocks by columns that its order begins with, such as the day of a time.
Each block is scanned by itself and summed up in one row; the rows of the blocks are scanned in
the same way, and what holds before a block is given to its rows. Sums, the greatest of running
sums, and last values can all be carried from block to block like that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(x: DataFrame, keys: list[str], order: list[str], block: list[str], sums: list[str], peaks: dict[str, str], lasts: list[str], reverse: bool) -> DataFrame:
    """Adds ``_x_before`` for each of the columns ``_x``, level by level: rows within blocks, blocks within coarser ones, these within keys."""
    w = Window.partitionBy(*keys, *block).orderBy(*[F.desc(c) if reverse else F.asc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"_{n}_before": F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)) for n in sums} | {f"_{n}_before": F.last(f"_{n}", ignorenulls=True).over(w) for n in lasts})
    if peaks:
        x = x.withColumns({f"_{p}_before": F.max(F.col(f"_{n}_before") + F.col(f"_{p}")).over(w) for p, n in peaks.items()})
    if not block:
        return x
    latest = F.min_by if reverse else F.max_by
    place = F.struct(*order)
    totals = x.groupBy(*keys, *block).agg(
        *[F.sum(f"_{n}").alias(f"_{n}") for n in sums],
        *[F.max(F.col(f"_{n}_before") + F.col(f"_{p}")).alias(f"_{p}") for p, n in peaks.items()],
        *[latest(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), place)).alias(f"_{n}") for n in lasts],
    )
    names = [*sums, *peaks, *lasts]
    carried = _before(totals, keys, [block[-1]], block[:-1], sums, peaks, lasts, reverse)
    carried = carried.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, *block)], *[F.col(f"_{n}_before").alias(f"_{n}_carried") for n in names])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, *block)])
    x = x.join(carried, same)
    whole = {n: F.col(f"_{n}_carried") + F.col(f"_{n}_before") for n in sums}
    whole |= {p: F.greatest(F.col(f"_{p}_carried"), F.col(f"_{n}_carried") + F.col(f"_{p}_before")) for p, n in peaks.items()}
    whole |= {n: F.coalesce(f"_{n}_before", f"_{n}_carried") for n in lasts}
    return x.withColumns({f"_{n}_before": c for n, c in whole.items()}).drop(*[f"_of_{c}" for c in (*keys, *block)], *[f"_{n}_carried" for n in names])


def scan(
    rows: DataFrame, keys: list[str], order: list[str], block: list[Column | str], sums: dict[str, Column] | None = None, peaks: dict[str, tuple[str, Column | None]] | None = None,
    lasts: dict[str, Column] | None = None, reverse: bool = False,
) -> DataFrame:
    """Adds ``<name>_before`` to each row for the rows of its key before it in ``order`` (after it, if ``reverse``).

    * ``sums``: the sum of a column, 0 for the first row;
    * ``peaks``: for (name of a sum, condition or None), the greatest value the sum had reached with any row before, or any
      that meets the condition; null if there is none;
    * ``lasts``: the last value that isn't null.

    ``block`` has columns or SQL expressions, coarse to fine, by which ``order`` is sorted too: its first columns, or what grows with the first one,
    such as a date. Choose them so that a finest block fits a task, and so that each has few blocks of the next finer kind;
    then no task has more than that however many rows a key has. Keys may be null. ``order`` should tell rows apart.
    """
    sums, peaks, lasts = sums or {}, peaks or {}, lasts or {}
    blocks = [f"_block{i}" for i in range(len(block))]
    own = {f"_{n}": c for n, c in (sums | lasts).items()}
    own |= {f"_{p}": sums[n] if when is None else F.when(when, sums[n]) for p, (n, when) in peaks.items()}
    x = rows.withColumns(own | {b: F.expr(c) if isinstance(c, str) else c for b, c in zip(blocks, block)})
    x = _before(x, keys, order, blocks, list(sums), {p: n for p, (n, _) in peaks.items()}, list(lasts), reverse)
    names = [*sums, *peaks, *lasts]
    return x.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_{n}_before").alias(f"{n}_before") for n in names])


def place(rows: DataFrame, keys: list[str], order: list[str], block: list[Column | str], out: str) -> DataFrame:
    """Adds ``out``: 1 for the first row of each key, and on."""
    return scan(rows, keys, order, block, sums={"_n": F.lit(1)}).withColumn(out, F.col("_n_before") + 1).drop("_n_before")
