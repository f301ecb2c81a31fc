"""Decision rows of held trades, look-ahead labels and exit policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import indicators as I
from .bars import BLOCK, by_bar, in_blocks
from .scans import place


def held_bars(trades: DataFrame, bars: DataFrame, least: int = 3) -> DataFrame:
    """One row for each bar a trade is held after its entry, with the running best and worst move in units of the stop distance.

    Only trades held ``least`` bars or more. Trades (sym, bar, direction, price, sl, exit_bar) meet bars by an equi-join on the bars they list.
    """
    t = trades.filter(F.col("exit_bar") - F.col("bar") >= least).withColumn("at", F.explode(F.sequence(F.col("bar") + 1, F.col("exit_bar"))))
    b = bars.select("sym", F.col("bar").alias("at"), "high", "low", "close")
    r = F.abs(F.col("price") - F.col("sl"))
    best = F.when(F.col("direction") == 1, F.col("high") - F.col("price")).otherwise(F.col("price") - F.col("low")) / r
    worst = F.when(F.col("direction") == 1, F.col("price") - F.col("low")).otherwise(F.col("high") - F.col("price")) / r
    w = Window.partitionBy("sym", "bar", "direction").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = t.join(b, ["sym", "at"]).withColumn("r_now", F.col("direction") * (F.col("close") - F.col("price")) / r)
    return x.withColumn("mfe", F.greatest(F.lit(0.0), F.max(best).over(w))).withColumn("mae", F.greatest(F.lit(0.0), F.max(worst).over(w))).withColumn("age", F.col("at") - F.col("bar"))


def labels(held: DataFrame, ahead: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Adds what is still to come: the result after some bars (the last one's, if the trade ends before), bars left, the best result left, whether
    the stop comes before the target (``reason`` 0 at a later bar), and the first bar of the trade's best result, its entry if no result is above 0."""
    w = Window.partitionBy("sym", "bar", "direction").orderBy("at")
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    x = held
    for k in ahead:
        x = x.withColumn(f"r_plus{k}", F.coalesce(F.lead("r_now", k).over(w), F.last("r_now").over(rest)))
    x = x.withColumn("bars_left", F.col("exit_bar") - F.col("at"))
    trade = Window.partitionBy("sym", "bar", "direction")
    best = F.max("r_now").over(trade)
    x = x.withColumn("stop_first", ((F.col("reason") == 0) & (F.col("bars_left") > 0)).cast("int"))
    x = x.withColumn("_best", best).withColumn("best_bar", F.when(F.col("_best") > 0, F.min(F.when(F.col("r_now") == F.col("_best"), F.col("at"))).over(trade)).otherwise(F.col("bar"))).drop("_best")
    return x.withColumn("best_left", F.max("r_now").over(rest)).withColumn("remaining_r", F.last("r_now").over(rest) - F.col("r_now"))


def exit_score(policy: str, hold: Column, risk: Column) -> Column:
    """Score of a policy: the risk, one less the value of holding, or the mean of both."""
    return {"risk": risk, "hold": 1 - hold, "dual": risk * 0.5 + (1 - hold) * 0.5}[policy]


def scores_by_bar(decisions: DataFrame, bars: DataFrame) -> DataFrame:
    """The greatest score of any trade on each bar, 0 where none is held."""
    top = decisions.groupBy("sym", F.col("at").alias("bar")).agg(F.max("score").alias("score"))
    return bars.select("sym", "bar").join(top, ["sym", "bar"], "left").na.fill(0.0, ["score"])


def calibrated(decisions: DataFrame, thresholds: list[float], keep: float = 0.5) -> DataFrame:
    """Mean result of the trades whose score reaches each threshold; thresholds that keep too few of all are left out."""
    x = decisions.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    a = x.groupBy("threshold").agg(F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("kept"), F.avg(F.when(F.col("score") >= F.col("threshold"), F.col("pnl"))).alias("mean"))
    return a.filter(F.col("kept") >= keep)


def folds(rows: DataFrame, n: int) -> DataFrame:
    """Expanding folds over time: fold k trains on the first k + 1 parts of n + 1 and tests on the next.

    Parts are as even as can be, longer ones first; a row's part follows from its place and the count of its instrument.
    """
    total = rows.groupBy("sym").agg(F.count("*").alias("_n"))
    at, each, more = F.col("_at") - 1, F.floor(F.col("_n") / (n + 1)), F.col("_n") % (n + 1)
    long = more * (each + 1)  # rows of the longer parts
    part = F.when(at < long, F.floor(at / (each + 1))).otherwise(more + F.floor((at - long) / F.greatest(each, F.lit(1)))).cast("int")
    rows = place(rows, ["sym"], ["bar"], [F.floor(F.col("bar") / BLOCK)], "_at").join(total, "sym").withColumn("_part", part).drop("_at", "_n")
    x = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return x.withColumn("role", F.when(F.col("_part") <= F.col("fold"), "train").when(F.col("_part") == F.col("fold") + 1, "test")).filter("role is not null").drop("_part")


def tightened_stop(mae: Column, n: Column, sl: Column, most: float = 0.45) -> Column:
    """A stop nearer to the worst move expected: by at most ``most``, and by less while n, the trades seen, is from 100 to 300."""
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n - 100) / 200.0))
    return sl * (1 - F.when(mae < 0.5, F.least(F.lit(most), 1 - mae)).otherwise(0.0) * trust)


def predicted_stop(mae: Column, n: Column, sl: Column, room: float = 1.5, least: float = 0.5) -> Column:
    """A stop at ``room`` times the worst move predicted, in units of the stop, but at least ``least`` of it; less is changed while n, the trades seen, is from 100 to 300."""
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n - 100) / 200.0))
    return sl * (1 - trust * (1 - F.greatest(F.lit(least), mae * room)))


#: How each of the eight bar features speaks for leaving a long and a short trade. Fixed values.
FLIPS = {"long": (-1, 1, 1, -1, 1, 1, -1, -1), "short": (1, 1, -1, 1, -1, 1, 1, -1)}


def urgency(features: list[Column], weights: list[float]) -> tuple[Column, Column]:
    """Weighted sums of the features, turned to the side of a long and of a short trade, at least 0."""
    long, short = (sum((f * (w * s) for f, w, s in zip(features, weights, FLIPS[side])), F.lit(0.0)) for side in ("long", "short"))
    return F.greatest(F.lit(0.0), long), F.greatest(F.lit(0.0), short)


def market_features(held: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds to held bars: distances to stop and target in units of the stop distance, the range against that at entry, slopes of 5 and 20 bars in ranges
    (within 3), changes of the RSI over 3 and 10 bars (a twentieth, within 1), hour and weekday."""
    past = lambda c, n: F.col(c) - F.lag(c, n).over(by_bar())
    frame = in_blocks(I.rsi(I.atr(bars, 14, "_atr"), 14, "_rsi"), 20, lambda x: x.withColumns({"_s5": past("close", 5), "_s20": past("close", 20), "_m3": past("_rsi", 3), "_m10": past("_rsi", 10)}))
    now = frame.select("sym", F.col("bar").alias("at"), F.col("close").alias("_close"), "_atr", "_s5", "_s20", "_m3", "_m10", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))
    entry = frame.select("sym", "bar", F.col("_atr").alias("_entry"))
    x = held.drop("hour", "weekday").join(now, ["sym", "at"]).join(entry, ["sym", "bar"])
    r = F.abs(F.col("price") - F.col("sl"))
    within = lambda c, most: F.greatest(F.lit(-most), F.least(F.lit(most), c))
    x = x.withColumns({
        "to_stop": F.abs(F.col("_close") - F.col("sl")) / r, "to_target": F.abs(F.col("tp") - F.col("_close")) / r, "range_ratio": F.try_divide("_atr", "_entry"),
        "slope_short": within(F.try_divide("_s5", "_atr"), 3.0), "slope_long": within(F.try_divide("_s20", "_atr"), 3.0), "momentum_short": within(F.col("_m3") / 20, 1.0), "momentum_long": within(F.col("_m10") / 20, 1.0),
    })
    return x.drop("_close", "_atr", "_s5", "_s20", "_m3", "_m10", "_entry")


def decision_features(held: DataFrame, longest: int) -> DataFrame:
    """Adds age, what was given back from the best and the share of the longest holding time to held bars."""
    age = F.col("at") - F.col("bar")
    return held.withColumns({"age": age, "given_back": F.greatest(F.lit(0.0), F.col("mfe") - F.col("r_now")), "age_share": F.least(F.lit(1.0), age / float(longest))})


def confidence(rows: DataFrame, risk: str, hold: str) -> DataFrame:
    """Adds confidence: half the risk, half what the value of holding lacks to its greatest, over its range."""
    span = rows.agg(F.min(hold).alias("_lo"), F.max(hold).alias("_hi"))
    x = rows.join(F.broadcast(span))  # one row
    share = F.when(F.col("_hi") > F.col("_lo"), F.try_divide(F.col(hold) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return x.withColumn("confidence", 0.5 * F.col(risk) + 0.5 * (1 - share)).drop("_lo", "_hi")


def trained(rows: DataFrame, features: list[str], label: str, kind: str = "classifier"):
    """Gradient-boosted trees of Spark's own library on feature columns; nulls count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    made = {"classifier": GBTClassifier, "regressor": GBTRegressor}[kind](labelCol=label, featuresCol="_x", maxIter=10, maxDepth=3, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), made]).fit(rows.fillna(0.0, features))


def skill(scored: DataFrame, score: str, label: str) -> float:
    """Area under the ROC curve; 0.5 where one class is missing."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    if scored.select(label).distinct().count() < 2:
        return 0.5
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label).evaluate(scored)
