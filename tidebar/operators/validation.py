"""Search tables, ranking, walk-forward windows, Monte-Carlo resampling and confidence scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .draws import blocks
from .scans import scan


def grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """All combinations of a stated parameter space, numbered by trial.

    A trial's number is read as digits in the sizes of the value lists, so rows are made where
    they are needed and no lists are joined.
    """
    total = reduce(mul, (len(v) for v in space.values()), 1)
    out, below = spark.range(total).select(F.col("id").alias("trial")), 1
    for name, values in space.items():
        out = out.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("trial") / below) % len(values) + 1).cast("int")))
        below *= len(values)
    return out


def random_trials(trials: DataFrame, n: int, seed: int) -> DataFrame:
    """n trials by the order of a keyed digest: the same on every machine."""
    return trials.withColumn("_key", F.md5(F.concat_ws("-", F.lit(seed), "trial"))).orderBy("_key").limit(n).drop("_key")


def range_cuts(rows: DataFrame, *columns: str, parts: int = 64) -> list[list[float]]:
    """For each column, at most ``parts`` - 1 values that cut it into ranges of about as many rows."""
    at = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = rows.agg(*[F.percentile_approx(c, at, F.lit(10_000)).alias(c) for c in columns]).first()
    return [sorted(set(map(float, found[c] or []))) for c in columns]


def ranked(rows: DataFrame, column: str, tie: str, out: str, cuts: list[float] | None = None) -> DataFrame:
    """Adds ``out``: 1 for the greatest value, ties by ``tie``. Rows are ranked within ranges of values; the counts of the ranges above, a row each, are added."""
    cuts = range_cuts(rows, column)[0] if cuts is None else cuts
    above = sum(((F.col(column) < c).cast("int") for c in cuts), F.lit(0)) + F.col(column).isNull().cast("int")
    x = rows.withColumn("_range", above)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = x.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_start"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(column), tie))
    return x.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def grid_neighbours(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Each value moved one step down and up its list of values, within it."""
    listed = F.array(*map(F.lit, values))
    at = F.array_position(listed, F.col(column)).cast("int")
    x = rows.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("_at", at + F.col("step"))
    return x.filter(F.col("_at").between(1, len(values))).withColumn("moved", F.element_at(listed, F.col("_at"))).drop("_at")


def combined_rank(results: DataFrame, weight: float, least_ratio: float) -> DataFrame:
    """Ranks by back and forward quality and their weighted sum; the forward-ratio filter is off where nothing passes it."""
    x = results.withColumn("ratio", F.when(F.col("back") > 0, F.try_divide("forward", "back")).otherwise(0.0))
    x = x.withColumn("_pass", (F.col("ratio") >= least_ratio).cast("int"))
    some = x.agg(F.max("_pass").alias("_any"))
    x = x.join(F.broadcast(some)).filter((F.col("_pass") == 1) | (F.col("_any") == 0)).drop("_pass", "_any")  # one row
    back, forward = range_cuts(results, "back", "forward")
    x = ranked(ranked(x, "back", "trial", "back_rank", back), "forward", "trial", "forward_rank", forward)
    return x.withColumn("combined_rank", F.col("back_rank") + weight * F.col("forward_rank"))


def diverse(candidates: DataFrame, signature: list[str], n: int, each: int) -> DataFrame:
    """n candidates: first the best of each signature, then up to ``each`` of one, then the rest, by rank within each pass."""
    place = F.row_number().over(Window.partitionBy(*signature).orderBy("combined_rank", "trial"))
    x = candidates.withColumn("_place", place)
    x = x.withColumn("pass", F.when(F.col("_place") == 1, 1).when(F.col("_place") <= each, 2).otherwise(3))
    return x.orderBy("pass", "combined_rank", "trial").limit(n).drop("_place")


def neighbours(params: DataFrame, share: float = 0.1) -> DataFrame:
    """Each numeric parameter (name, value, low, high, whole) moved down and up by a share of its value, within its range."""
    step = F.when(F.col("whole"), F.greatest(F.lit(1.0), F.floor(F.abs("value") * share))).otherwise(F.abs("value") * share)
    x = params.withColumn("sign", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("moved", F.least("high", F.greatest("low", F.col("value") + F.col("sign") * step)))
    return x.filter(F.col("moved") != F.col("value"))


def stability(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, least, stable and unstable counts of the ratios above 0 of each key, and a rating."""
    ok = F.when(F.col("ratio") > 0, F.col("ratio"))
    x = ratios.groupBy(*keys).agg(F.avg(ok).alias("mean"), F.min(ok).alias("least"), F.count_if(F.col("ratio") > 0.7).alias("stable"), F.count_if(F.col("ratio") < 0.3).alias("unstable"))
    m, low = F.coalesce("mean", F.lit(0.0)), F.coalesce("least", F.lit(0.0))
    rating = F.when((m >= 0.8) & (low >= 0.5), "ROBUST").when(m >= 0.6, "MODERATE").when(m >= 0.4, "FRAGILE").otherwise("OVERFIT")
    return x.withColumn("rating", rating)


def windows(spans: DataFrame, anchor: int = 6, train: int = 6, test: int = 6, roll: int = 3, tail_days: int = 7) -> DataFrame:
    """Rolling windows of whole months of each instrument (sym, first, last); a test may end ``tail_days`` after the data and is cut there."""
    months = F.floor(F.months_between("last", "first")).cast("int")
    x = spans.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(months, F.lit(0)))))
    start = F.add_months("first", anchor + F.col("k") * roll)
    x = x.withColumn("train_start", start).withColumn("train_end", F.add_months("first", anchor + train + F.col("k") * roll)).withColumn("test_end", F.add_months("first", anchor + train + test + F.col("k") * roll))
    x = x.withColumn("test_start", F.col("train_end")).filter(F.col("test_end") <= F.date_add("last", tail_days)).withColumn("test_end", F.least("test_end", "last"))
    return x.select("sym", F.col("k").alias("window"), "train_start", "train_end", "test_start", "test_end")


def window_stats(results: DataFrame, keys: list[str]) -> DataFrame:
    """Pass rates, Sharpe moments and consistency over windows (passed, sharpe, oos), and the gate on out-of-sample windows if there are any."""
    passed = F.avg(F.col("passed").cast("double"))
    oos = F.when(F.col("oos"), F.col("passed").cast("double"))
    x = results.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), passed.alias("pass_rate"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"), F.min("sharpe").alias("min_sharpe"), F.max("sharpe").alias("max_sharpe"),
        F.count_if("oos").alias("oos_windows"), F.avg(oos).alias("oos_pass_rate"), F.avg(F.when(F.col("oos"), F.col("sharpe"))).alias("oos_mean_sharpe"),
    )
    x = x.withColumn("consistency", F.col("mean_sharpe") / (F.col("std_sharpe") + 0.01))
    rate = F.coalesce("oos_pass_rate", "pass_rate")
    return x.withColumn("gate", (rate >= 0.75) & (F.coalesce("oos_mean_sharpe", "mean_sharpe") >= 0.5))


# --- resampling by digests: the same numbers on every engine ---------------------------------

#: Trades up to which a group's draws are made inside a call, on arrays of that length, and the iterations of a call; larger groups make a row a draw.
HELD, EACH = 20_000, 1000


def _draw(kind: str, seed: int, *parts: str) -> Column:
    """A number from 0 to 2**32 - 1 from the md5 of seed and parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(f"{kind}{seed}"), *parts)), 1, 8), 16, 10).cast("long")


def _iterations(trades: DataFrame, n: int, kind: str, seed: int) -> DataFrame:
    return trades.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("draw", _draw(kind, seed, "iter", "grp", "n"))


def _resampled(trades: DataFrame, n: int, kind: str, seed: int, of_trades: Callable[[np.ndarray], Callable[[np.ndarray], tuple]], columns: list[str], by_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """grp, iter and ``columns`` for each of ``n`` iterations over the trades (grp, n, pnl; n from 0) of each group.

    The trades of a group of at most ``HELD`` come together once. ``of_trades`` gets them and returns what turns the draws of some
    iterations, a row each, both in order of n, into columns; only what that sums up leaves the task. So a task holds ``HELD`` trades
    and a block of draws, and no row is a draw. Larger groups go through ``by_rows``, which shuffles a row a draw and holds none; their
    list, which a table has at most one in ``HELD`` rows of, is broadcast, so no other trade is joined to a count.
    """
    large = F.broadcast(trades.groupBy("grp").agg(F.count("*").alias("_size")).filter(F.col("_size") > HELD).select("grp"))
    kind_of = trades.schema["grp"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        names = [str(k).encode() for k in table.column("n").to_pylist()]
        group = table.column("name")[0].as_py()
        first = table.column("part")[0].as_py() * EACH
        every = range(first, min(n, first + EACH))
        one = of_trades(table.column("pnl").to_numpy())
        fronts = [f"{kind}{seed}-{i}-{group}-".encode() for i in every]
        out = [one(x) for _, same in groupby(fronts, len) for x in blocks(list(same), names)]  # numbers of as many digits are drawn together
        grp = table.column("grp").combine_chunks()[:1]
        columns_out = [pa.array(np.concatenate(c).astype(np.float64)) for c in zip(*out)]
        return pa.table([grp.take(pa.array([0] * len(every))), pa.array(every, pa.int32()), *columns_out], names=["grp", "iter", *columns])

    tasks = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number isn't cut down for small tables: the draws are the work
    part = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // EACH))) if n > EACH else F.lit(0)
    held = trades.filter("grp is not null").join(large, "grp", "left_anti").select("grp", F.col("grp").cast("string").alias("name"), "n", "pnl", part.alias("part")).repartition(tasks, "grp", "part")
    held = held.groupBy("grp", "part").applyInArrow(run, f"grp {kind_of}, iter int, {', '.join(f'{c} double' for c in columns)}")
    return held.unionByName(by_rows(trades.join(large, "grp", "left_semi")).select("grp", F.col("iter").cast("int").alias("iter"), *columns))


def whole_cents(pnl: np.ndarray) -> np.ndarray | None:
    """Amounts as cents, if they are whole and their sums, and the square of any, are exact in 64 bits, and their sums of squares in a double."""
    cents = np.rint(pnl * 100)
    most = np.abs(cents).max(initial=0)
    return cents if (cents / 100 == pnl).all() and len(pnl) * most < 2**31 and len(pnl) * most**2 < 2**53 else None


def score_of(x: np.ndarray) -> np.ndarray:
    """Mean over deviation of each row; 0 without any deviation."""
    dev = x.std(axis=1, ddof=1) if x.shape[1] > 1 else np.zeros(len(x))
    return np.divide(x.mean(axis=1), dev, out=np.zeros(len(x)), where=dev > 0)


def shuffled(trades: DataFrame, n: int, capital: float, seed: int = 42) -> DataFrame:
    """Return and greatest drawdown of the trades (grp, n, pnl) of a group in ``n`` orders."""

    def of(pnl: np.ndarray) -> Callable[[np.ndarray], tuple]:
        at, ret = np.arange(len(pnl), dtype=np.uint64), pnl.sum() * 100 / capital

        def one(draws: np.ndarray) -> tuple:
            order = (np.sort(draws.astype(np.uint64) << np.uint64(32) | at, axis=1) & np.uint64(0xFFFFFFFF)).astype(np.intp)
            equity = capital + np.cumsum(pnl.take(order), axis=1)
            peak = np.maximum(np.maximum.accumulate(equity, axis=1), capital)
            return np.full(len(draws), ret), ((peak - equity) * 100 / peak).max(axis=1)

        return one

    def rows(t: DataFrame) -> DataFrame:
        x = scan(_iterations(t, n, "s", seed), ["grp", "iter"], ["draw", "n"], [F.floor(F.col("draw") / 2**20)], sums={"gain": F.col("pnl")}, peaks={"top": ("gain", None)})
        x = x.withColumn("equity", capital + F.col("gain_before") + F.col("pnl"))
        x = x.withColumn("peak", F.greatest(F.lit(capital), capital + F.col("top_before"), "equity"))
        return x.groupBy("grp", "iter").agg((F.sum("pnl") * 100 / capital).alias("ret"), F.max((F.col("peak") - F.col("equity")) * 100 / F.col("peak")).alias("max_dd"))

    return _resampled(trades, n, "s", seed, of, ["ret", "max_dd"], rows)


def bootstrapped(trades: DataFrame, n: int, seed: int = 12345) -> DataFrame:
    """Sharpe, win rate and profit factor of draws with replacement, as many as the group has trades; n counts from 0."""

    def of(pnl: np.ndarray) -> Callable[[np.ndarray], tuple]:
        cents, size = whole_cents(pnl), len(pnl)

        def one(draws: np.ndarray) -> tuple:
            times = draws // np.uint32(size)  # a remainder takes three times as long
            times *= np.uint32(size)
            pick = (draws - times).astype(np.intp)
            x = (pnl if cents is None else cents).take(pick)
            wins, won = (x > 0).sum(axis=1) * 100 / size, np.maximum(x, 0.0).sum(axis=1)
            if cents is None:
                lost, score = -np.minimum(x, 0.0).sum(axis=1), score_of(x)
            else:  # a few exact sums in place of a mean and deviations from it
                total = x.sum(axis=1)
                lost = won - total
                spread = size * np.einsum("ij,ij->i", x, x).astype(np.int64) - total.astype(np.int64) ** 2
                dev = np.sqrt(spread / (size * max(1, size - 1)))
                score, won, lost = np.divide(total / size, dev, out=np.zeros(len(x)), where=spread > 0), won / 100, lost / 100
            factor = np.divide(won, lost, out=np.full(len(x), 100.0), where=lost > 0.01)
            return score * size**0.5, wins, factor

        return one

    def rows(t: DataFrame) -> DataFrame:
        size = t.groupBy("grp").agg(F.count("*").alias("size"))
        x = _iterations(t.select("grp", "n"), n, "b", seed).join(size, "grp").withColumn("pick", F.col("draw") % F.col("size"))
        y = x.join(t.select("grp", F.col("n").alias("pick"), "pnl"), ["grp", "pick"])
        win, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") <= 0, -F.col("pnl")).otherwise(0.0))
        a = y.groupBy("grp", "iter").agg(F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"), F.count("*").alias("c"), (F.count_if(F.col("pnl") > 0) * 100 / F.count("*")).alias("win_rate"), win.alias("w"), loss.alias("l"))
        return a.select("grp", "iter", F.when(F.col("s") > 0, F.try_divide(F.col("m"), F.col("s")) * F.sqrt("c")).otherwise(0.0).alias("sharpe"), "win_rate", F.when(F.col("l") > 0.01, F.try_divide("w", "l")).otherwise(100.0).alias("profit_factor"))

    return _resampled(trades, n, "b", seed, of, ["sharpe", "win_rate", "profit_factor"], rows)


def permutation(trades: DataFrame, n: int, seed: int = 54321) -> DataFrame:
    """Share of ``n`` random sign flips whose t-like score is at least the group's own."""

    def of(pnl: np.ndarray) -> Callable[[np.ndarray], tuple]:
        cents, own = whole_cents(pnl), score_of(pnl[None])
        if cents is None or (np.abs(cents) == np.abs(cents[0])).all():  # only then may all flipped amounts be equal
            return lambda draws: (score_of(np.where(draws & 1 == 0, pnl, -pnl)) >= own,)
        # flips keep the sum of squares, so the score grows with the sum, which is at least the own one if those flipped add up to 0 or less
        return lambda draws: (np.einsum("ij,j->i", (draws & np.uint32(1)).astype(np.float64), cents) <= 0,)

    def rows(t: DataFrame) -> DataFrame:
        x = _iterations(t, n, "p", seed).withColumn("flipped", F.when(F.col("draw") % 2 == 0, F.col("pnl")).otherwise(-F.col("pnl")))
        score = lambda c: F.when(F.stddev_samp(c) > 0, F.try_divide(F.avg(c), F.stddev_samp(c))).otherwise(0.0)
        flips = x.groupBy("grp", "iter").agg(score("flipped").alias("score"))
        own = t.groupBy("grp").agg(score("pnl").alias("own"))
        return flips.join(own, "grp").select("grp", "iter", (F.col("score") >= F.col("own")).cast("double").alias("reached"))

    return _resampled(trades, n, "p", seed, of, ["reached"], rows).groupBy("grp").agg(F.avg("reached").alias("p_value"))


def distribution(values: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Percentiles, value at risk, expected shortfall and chances of a column over iterations, of which a key has a stated number.

    ``values`` is asked for once, as its draws are the work; so a key's values come together, once, and are sorted.
    """
    x = values.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias("_all")).withColumn("_n", F.size("_all")).filter("_n > 0")

    def percentile(q: int) -> Column:
        at = (F.col("_n") - 1) * q / 100
        low, high = F.element_at("_all", F.floor(at).cast("int") + 1), F.element_at("_all", F.ceil(at).cast("int") + 1)
        return low + (high - low) * (at - F.floor(at))

    share = lambda q: F.size(F.filter("_all", lambda v: v > q)) / F.col("_n")
    x = x.select(*keys, "_all", *[percentile(q).alias(f"p{q}") for q in (5, 25, 50, 75, 95)], *[share(q).alias(f"above{q}") for q in (0, 5, 10)])
    x = x.withColumn("_tail", F.filter("_all", lambda v: v <= F.col("p5")))
    return x.withColumn("shortfall", F.aggregate("_tail", F.lit(0.0), lambda a, v: a + v) / F.size("_tail")).drop("_all", "_tail")


# --- confidence ------------------------------------------------------------------------------


def ramp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - low) * 100 / (high - low)))


def confidence(candidates: DataFrame) -> DataFrame:
    """Score from 0 to 100 of six weighted parts, capped where the whole equity curve is poor, and a rating.

    Columns: profit_factor, sortino, r_squared, trades, max_dd, ulcer, ratio, pass_rate, oos_windows, oos_pass_rate,
    mean_sharpe, oos_mean_sharpe, consistency, mean_stability, unstable, sharpe_low, pf_low, significant, quality, back_quality.
    """
    c = F.col
    bt = (ramp(c("profit_factor"), 1, 3) + ramp(c("sortino"), 0, 3) + ramp(c("r_squared"), 0, 0.9) + ramp(c("trades"), 30, 100) + F.greatest(F.lit(0.0), F.least(F.lit(100.0), (30 - (c("ulcer") + c("max_dd") / 2)) / 30 * 100))) / 5
    fb = F.when(c("ratio") <= 0, 0.0).when(c("ratio") <= 1, c("ratio") * 100).when(c("ratio") <= 2, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - (c("ratio") - 2) * 20))
    oos = c("oos_windows") > 0
    rate, sharpe = F.when(oos, c("oos_pass_rate")).otherwise(c("pass_rate")), F.when(oos, c("oos_mean_sharpe")).otherwise(c("mean_sharpe"))
    wf = F.greatest(F.lit(0.0), F.least(F.lit(100.0), rate * 100 + F.least(F.lit(10.0), F.greatest(F.lit(-40.0), (sharpe - 1) * 30))))
    wf = F.when(c("oos_windows") == 1, wf * 0.7 + c("pass_rate") * 100 * 0.3).otherwise(wf)
    wf = F.when(c("consistency") > 2, F.least(wf + 10, F.lit(100.0))).otherwise(wf)
    st = F.least(F.lit(100.0), c("mean_stability") * 100) * F.when(c("unstable") > 3, 0.8).otherwise(1.0)
    mc = ramp(c("sharpe_low"), 0, 2)
    mc = F.when(c("pf_low") > 1, F.least(mc + 10, F.lit(100.0))).otherwise(mc) * F.when(c("significant"), 1.0).otherwise(0.5)
    qs = F.least(c("quality") / 3, F.lit(1.0)) * 100
    total = bt * 0.15 + fb * 0.15 + wf * 0.25 + st * 0.15 + mc * 0.15 + qs * 0.15
    caps = [F.when(c("r_squared") < 0.3, 50.0), F.when(c("max_dd") > 50, 40.0), F.when((c("back_quality") > 0) & (c("back_quality") < 0.5), 50.0), F.when(c("ulcer") > 20, 40.0).when(c("ulcer") > 10, 70.0)]
    x = candidates.withColumn("score", F.least(total, F.lit(100.0), *caps))
    return x.withColumn("rating", F.when(F.col("score") >= 70, "GREEN").when(F.col("score") >= 40, "YELLOW").otherwise("RED"))
