"""Models of every walk-forward window from all rows known before it, trained in one pass.

The models are made of sums over bins of features, so the model of a window is that of the window before
and the sums of the rows that became known since: rows are summed once by window and bin, on the map side
first, and running totals over the windows give all models at once. No row trains twice and no window is fitted by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def so_far(rows: DataFrame, asked: DataFrame, by: list[str], block: str, sums: list[str]) -> DataFrame:
    """For each asked (``by``, ``block``), the totals of the columns ``sums`` over the rows of equal ``by`` of that block and all before it."""
    have = rows.groupBy(*by, block).agg(*[F.sum(s).alias(s) for s in sums]).withColumn("_ask", F.lit(0))
    none = [F.lit(0).cast(have.schema[s].dataType).alias(s) for s in sums]
    want = asked.select(*by, block).distinct().select(*by, block, *none, F.lit(1).alias("_ask"))
    w = Window.partitionBy(*by).orderBy(block, "_ask").rowsBetween(Window.unboundedPreceding, 0)  # two rows a block at most
    return have.unionByName(want).withColumns({s: F.sum(s).over(w) for s in sums}).filter("_ask = 1").drop("_ask")


def _models(rows: DataFrame, keys: list[str], window: Column, ready: Column, bins: dict[str, tuple[Column, int]], sums: dict[str, Column]) -> DataFrame:
    """keys, _window, the totals of ``sums`` as ``all_<name>``, and ``cells``: (feature, bin, totals) of each window, from rows ready by then."""
    x = rows.withColumns({"_window": window.cast("long"), "_ready": ready.cast("long")} | {f"_{n}": c for n, c in sums.items()})
    names = [f"_{n}" for n in sums]
    asked = x.select(*keys, "_window").distinct()
    known = x.filter("_ready is not null").withColumn("_asked", F.col("_ready")).drop("_window").withColumnRenamed("_asked", "_window")
    whole = so_far(known, asked, keys, "_window", names).withColumnsRenamed({n: f"all{n}" for n in names})
    places = F.array(*[F.struct(F.lit(f).alias("feature"), b.cast("int").alias("bin")) for f, (b, _) in bins.items()])
    every = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(b).alias("bin")) for f, (_, size) in bins.items() for b in range(size)])
    split = lambda df, at: df.withColumn("_at", F.explode(at)).select("*", F.col("_at.feature").alias("_feature"), F.col("_at.bin").alias("_bin"))
    cells = so_far(split(known, places), split(asked, every), [*keys, "_feature", "_bin"], "_window", names)
    held = cells.groupBy(*keys, "_window").agg(F.collect_list(F.struct("_feature", "_bin", *names)).alias("cells"))  # as many as there are bins
    return whole.join(held, [*keys, "_window"])


def _weight(weights: Column, bins: dict[str, tuple[Column, int]]) -> Column:
    """Sum of the weights of the bins of a row."""
    return reduce(lambda a, b: a + b, [F.coalesce(weights[F.concat_ws(":", F.lit(f), b.cast("int").cast("string"))], F.lit(0.0)) for f, (b, _) in bins.items()])


def classified(rows: DataFrame, keys: list[str], window: Column, ready: Column, bins: dict[str, tuple[Column, int]], label: Column, least: int = 20) -> DataFrame:
    """Adds ``trained`` (rows known before the window of a row) and ``score``: the log odds of ``label`` by naive Bayes over bins, null below ``least`` rows.

    ``window`` numbers the window a row is judged in; ``ready`` is the first window that may train on it, null if none. ``bins`` has
    for each feature its bin, from 0, and the number of bins; counts are smoothed by one row a bin and label.
    """
    sums = {"yes": label.cast("long"), "no": (~label).cast("long")}
    m = _models(rows, keys, window, ready, bins, sums)
    size = F.create_map(*[F.lit(x) for f, (_, n) in bins.items() for x in (f, n)])
    ratio = lambda c: F.ln((c["_yes"] + 1) / (F.col("all_yes") + size[c["_feature"]])) - F.ln((c["_no"] + 1) / (F.col("all_no") + size[c["_feature"]]))
    weights = F.map_from_entries(F.transform("cells", lambda c: F.struct(F.concat_ws(":", c["_feature"], c["_bin"].cast("string")), ratio(c))))
    prior = F.ln((F.col("all_yes") + 1) / (F.col("all_no") + 1))
    m = m.select(*keys, "_window", (F.col("all_yes") + F.col("all_no")).alias("trained"), prior.alias("_prior"), weights.alias("_weights"))
    x = rows.withColumn("_window", window.cast("long")).join(m, [*keys, "_window"])
    score = F.when(F.col("trained") >= least, F.col("_prior") + _weight(F.col("_weights"), bins))
    return x.withColumn("score", score).drop("_window", "_prior", "_weights")


def predicted(rows: DataFrame, keys: list[str], window: Column, ready: Column, cell: tuple[Column, int], target: Column, least: int = 200, shrink: float = 20.0) -> DataFrame:
    """Adds ``trained`` and ``prediction``: the mean target of the rows known before a window in a row's cell, drawn to the mean of all of them as by ``shrink`` rows; null below ``least`` rows."""
    m = _models(rows, keys, window, ready, {"cell": cell}, {"n": F.lit(1).cast("long"), "sum": target})
    mean = F.try_divide(F.col("all_sum"), F.col("all_n"))
    values = F.map_from_entries(F.transform("cells", lambda c: F.struct(F.concat_ws(":", c["_feature"], c["_bin"].cast("string")), (c["_sum"] + shrink * mean) / (c["_n"] + shrink))))
    m = m.select(*keys, "_window", F.col("all_n").alias("trained"), values.alias("_values"))
    x = rows.withColumn("_window", window.cast("long")).join(m, [*keys, "_window"])
    return x.withColumn("prediction", F.when(F.col("trained") >= least, _weight(F.col("_values"), {"cell": cell}))).drop("_window", "_values")
