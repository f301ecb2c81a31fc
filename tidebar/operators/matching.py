"""Time-tolerant joins: nearest and scored matches, pairing, differences, idempotent inserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import scan


#: Microseconds of a block of time from which scans carry on.
DAY = 86_400_000_000


def best(matches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first match of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return matches.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], seconds: float, left_id: str, right_id: str, ts: str = "ts") -> DataFrame:
    """Every left row with its nearest right row within ``seconds``, ties to the lesser id; null where there is none.

    A merge of both in time: each left row gets the last right row at or before it and the first one after it, carried from
    day to day, so there are two candidates a row however dense the right rows are. ``left_id`` tells left rows apart.
    """
    at = F.unix_micros(F.col(ts)).alias("_at")
    rows = left.select(*keys, at, F.lit(1).alias("_side"), F.col(left_id).alias("_left"), F.lit(None).cast(right.schema[right_id].dataType).alias("_right"))
    seen = right.groupBy(*keys, at).agg(F.min(right_id).alias("_right")).select(*keys, "_at", F.lit(0).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias("_left"), "_right")
    day, found = [F.floor(F.col("_at") / DAY)], {"_found": F.when(F.col("_side") == 0, F.struct("_at", "_right"))}
    both = scan(rows.unionByName(seen), keys, ["_at", "_side"], day, lasts=found).withColumnRenamed("_found_before", "_last")
    both = scan(both, keys, ["_at", "_side"], day, lasts=found, reverse=True).filter("_side = 1")
    gap = lambda c: F.abs(F.col(f"{c}._at") - F.col("_at")) / 1e6
    candidate = lambda c: F.when(gap(c) <= seconds, F.struct(gap(c).alias("gap"), F.col(f"{c}._right").alias("id")))
    one = F.array_min(F.array_compact(F.array(candidate("_last"), candidate("_found_before"))))
    matched = both.select(F.col("_left").alias(left_id), one["id"].alias(right_id), one["gap"].alias("gap"))
    return left.join(matched, left_id, "left")


def pair_up(events: DataFrame, keys: list[str], order: list[str], entry: Column, exit_: Column, id_col: str) -> DataFrame:
    """Each entry with the exit that is the next event of its key; null if another entry or nothing follows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = events.withColumn("_exit", exit_).withColumn("_next", F.lead("_exit").over(w)).withColumn("_id", F.lead(id_col).over(w))
    return x.filter(entry).select(*keys, F.col(id_col).alias("entry_id"), F.when(F.col("_next"), F.col("_id")).alias("exit_id"))


def differences(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison on all keys: a row for each key and side ('both', 'actual only' or 'expected only') with ``rows``, the rows of the join it stands for.

    Both are counted by key, in one shuffle, not joined. Nulls equal nothing, so a key with a null never has both.
    """
    alone = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    one = lambda x, side: x.select(*keys, F.when(alone, side == 1).alias("_alone"), F.lit(side).alias("_a"), F.lit(1 - side).alias("_e"))
    n = one(actual, 1).unionByName(one(expected, 0)).groupBy(*keys, "_alone").agg(F.sum("_a").alias("_a"), F.sum("_e").alias("_e"))
    side = F.when(F.col("_a") == 0, "expected only").when(F.col("_e") == 0, "actual only").otherwise("both")
    return n.select(*keys, side.alias("side"), F.when((F.col("_a") > 0) & (F.col("_e") > 0), F.col("_a") * F.col("_e")).otherwise(F.col("_a") + F.col("_e")).alias("rows"))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those ``rows`` whose keys it doesn't have; running it again adds nothing."""
    return table.unionByName(rows.join(table.select(*keys).distinct(), keys, "left_anti"))


def first_within(left: DataFrame, right: DataFrame, keys: list[str], seconds: float, left_id: str, right_id: str, ts: str = "ts") -> DataFrame:
    """left_id, right_id: the first right row, by id, less than ``seconds`` from each left row that has one.

    Time is cut into blocks as long as the whole reach of a left row, which so spans the end of one block and the beginning of
    the next. It asks for the least id from its earliest time on in the one and up to its latest time in the other:
    two questions a row however dense the right rows are, answered by running minima.
    """
    reach = max(1, round(seconds * 1e6))
    at = F.unix_micros(F.col(ts))
    block = F.floor(F.col("_at") / (2 * reach)).alias("_block")
    nothing = F.lit(None).cast(left.schema[left_id].dataType)
    asked = F.explode(F.array(F.struct((at - reach).alias("_at"), F.lit(1).alias("_side")), F.struct((at + reach).alias("_at"), F.lit(-1).alias("_side")))).alias("_q")
    rows = left.select(*keys, F.col(left_id).alias("_left"), asked).select(*keys, "_left", F.lit(None).cast(right.schema[right_id].dataType).alias("_right"), "_q._at", "_q._side")
    rows = rows.unionByName(right.select(*keys, nothing.alias("_left"), F.col(right_id).alias("_right"), at.alias("_at"), F.lit(0).alias("_side"))).select("*", block)
    # right rows at the very time asked for are too far: questions back come behind them, questions ahead before them
    w = Window.partitionBy(*keys, "_block")
    ahead = F.min("_right").over(w.orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1))
    back = F.min("_right").over(w.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, -1))
    answers = rows.withColumn("_first", F.when(F.col("_side") == 1, ahead).when(F.col("_side") == -1, back)).filter("_side <> 0 and _first is not null")
    return answers.groupBy(F.col("_left").alias(left_id)).agg(F.min("_first").alias(right_id))


def least_score(left: DataFrame, right: DataFrame, keys: list[str], seconds: float, weight: float, left_id: str, right_id: str, value: str = "price", ts: str = "ts") -> DataFrame:
    """left_id, right_id, score: of the right rows at most ``seconds`` away, that of the least gap in seconds plus ``weight`` times the difference of values, ties to the lesser id.

    A sweep in blocks of time, each with the right rows ``seconds`` around it: a left row looks at its neighbours in time,
    outwards, and stops where the gap alone exceeds the best score so far. No pairs are listed. Many blocks are swept at once,
    as their rows come sorted; a task holds the rows of a batch and of one block. Null keys and times match nothing.
    """
    reach = max(1, round(seconds * 1e6))
    at = F.unix_micros(F.col(ts))
    block = lambda c: F.floor(c / reach)
    kinds = {c: left.schema[c].dataType for c in (left_id,)} | {c: right.schema[c].dataType for c in (right_id,)}
    left, right = (x.dropna(subset=[*keys, ts]) for x in (left, right))
    rows = left.select(*keys, at.alias("_at"), F.col(value).cast("double").alias("_value"), F.col(left_id).alias("_left"), F.lit(None).cast(kinds[right_id]).alias("_right"), block(at).alias("_block"))
    near = right.select(*keys, at.alias("_at"), F.col(value).cast("double").alias("_value"), F.lit(None).cast(kinds[left_id]).alias("_left"), F.col(right_id).alias("_right"), F.explode(F.sequence(block(at) - 1, block(at) + 1)).alias("_block"))
    by = [*keys, "_block"]

    def sweep(pieces: list[pa.Table]) -> list[pa.RecordBatch]:
        table = pa.concat_tables(pieces)
        if not table.num_rows:
            return []
        group = np.append(0, np.cumsum(_changes(table, by)))
        mine, theirs = (pc.is_valid(table.column(c)).to_numpy() for c in ("_left", "_right"))
        own, others = table.filter(pa.array(mine)), table.filter(pa.array(theirs))
        t, v = others.column("_at").to_numpy(), others.column("_value").to_numpy()
        time, price = own.column("_at").to_numpy(), own.column("_value").to_numpy()
        start = np.cumsum(theirs)[mine]  # left rows come before right ones of their time
        first, end = (np.searchsorted(group[theirs], group[mine], side) for side in ("left", "right"))
        score, chosen = np.full(len(time), np.inf), np.full(len(time), -1)
        rank = np.argsort(np.argsort(others.column("_right").to_numpy(), kind="stable"), kind="stable")
        for step in (1, -1):
            at, live = start + (0 if step == 1 else -1), np.arange(len(time))
            while len(live):
                at, live = (x[(at >= first[live]) & (at < end[live])] for x in (at, live))
                gap = np.abs(t[at] - time[live]) / 1e6
                on = gap <= np.minimum(seconds, score[live])
                at, live, gap = at[on], live[on], gap[on]
                s = gap + np.abs(price[live] - v[at]) * weight
                old = chosen[live]
                take = (s < score[live]) | ((s == score[live]) & ((old < 0) | (rank[at] < rank[old])))
                score[live[take]], chosen[live[take]] = s[take], at[take]
                at = at + step
        kept = np.flatnonzero(chosen >= 0)
        return pa.table([own.column("_left").take(pa.array(kept)), others.column("_right").take(pa.array(chosen[kept])), pa.array(score[kept])], names=[left_id, right_id, "score"]).to_batches()

    def sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the block that may go on
        for table in (pa.Table.from_batches([b]) for b in batches if b.num_rows):
            ends = np.flatnonzero(_changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table]), by)) if held else 1 + np.flatnonzero(_changes(table, by))
            if len(ends):
                yield from sweep([*held, table.slice(0, ends[-1])])
                held = []
            held.append(table.slice(ends[-1] if len(ends) else 0))
        if held:
            yield from sweep(held)

    schema = f"`{left_id}` {kinds[left_id].simpleString()}, `{right_id}` {kinds[right_id].simpleString()}, score double"
    return rows.unionByName(near).repartition(*by).sortWithinPartitions(*by, "_at", "_right").mapInArrow(sweeps, schema)


def _changes(table: pa.Table, by: list[str]) -> np.ndarray:
    """Whether each row but the first differs in ``by`` from the one before."""
    codes = (table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in by)
    return np.any([c[1:] != c[:-1] for c in codes], axis=0)


def nearest_bar(left: DataFrame, right: DataFrame, keys: list[str], bars: int) -> DataFrame:
    """Every left row (keys, bar) with the nearest right row's bar ``other`` within ``bars``, ties to the earlier; null where there is none."""
    asked = left.withColumn("other", F.explode(F.sequence(F.col("bar") - bars, F.col("bar") + bars)))
    gap = F.abs(F.col("other") - F.col("bar"))
    found = asked.join(right, [*keys, "other"]).groupBy(*keys, "bar").agg(F.min(F.struct(gap.alias("gap"), "other"))["other"].alias("other"))
    return left.join(found, [*keys, "bar"], "left")


def preceding(rows: DataFrame, keys: list[str], order: list[str], block: list[Column | str], anchor: Column, seconds: float, id_col: str, ts: str = "ts") -> DataFrame:
    """Adds ``linked``: the id of the last anchor row before, if it lies less than ``seconds`` back; anchors are carried from block to block."""
    x = scan(rows, keys, order, block, lasts={"_anchor": F.when(anchor, F.struct(F.col(id_col).alias("id"), F.col(ts).alias("ts")))})
    near = F.col(ts).cast("double") - F.col("_anchor_before.ts").cast("double") < seconds
    return x.withColumn("linked", F.when(near, F.col("_anchor_before.id"))).drop("_anchor_before")
