"""How much of the variance of a score each parameter, and each pair of them, explains."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def importance(results: DataFrame, parameters: list[str], score: str) -> DataFrame:
    """first, second (null for the effect of one), cells, share: a functional decomposition of the variance of ``score``.

    The effect of a value is its mean score less the mean of all; that of a pair of values is its mean less both
    effects and the mean of all. A share is the mean square of an effect, each row counting once, over the variance of
    the score: null where the score doesn't vary. Null values of a parameter are a value; rows without a score don't count.

    The rows are summed once, by all parameters; grouping sets of these sums give every value and every pair of values, and only they, whose
    number is that of the values tried, are joined.
    """
    x = results.filter(F.col(score).isNotNull()).select(*[F.col(p).cast("string").alias(p) for p in parameters], F.col(score).cast("double").alias("_s"))
    cells = x.groupBy(*parameters).agg(F.count("*").alias("_n"), F.sum("_s").alias("_s"), F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    sets = [[], *[[p] for p in parameters], *map(list, combinations(parameters, 2))]
    named = [F.struct(F.lit(p).alias("name"), F.col(p).alias("value"), F.col(f"_g{i}").alias("absent")) for i, p in enumerate(parameters)]
    sums = cells.groupingSets(sets, *parameters).agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"), F.sum("_q").alias("q"), *[F.grouping(p).alias(f"_g{i}") for i, p in enumerate(parameters)])
    sums = sums.select("n", (F.col("s") / F.col("n")).alias("mean"), "q", F.filter(F.array(*named), lambda p: p["absent"] == 0).alias("at"))
    whole = sums.filter((F.size("at") == 0) & (F.col("n") > 0)).select(F.col("n").alias("rows"), F.col("mean").alias("middle"), (F.col("q") / F.col("n") - F.col("mean") * F.col("mean")).alias("variance"))
    one = sums.filter(F.size("at") == 1).join(F.broadcast(whole)).select(F.col("at")[0]["name"].alias("name"), F.col("at")[0]["value"].alias("value"), "n", (F.col("mean") - F.col("middle")).alias("effect"), "rows", "variance")  # one row
    side = lambda k: one.select(F.col("name").alias(f"name{k}"), F.col("value").alias(f"value{k}"), F.col("effect").alias(f"effect{k}"))
    two = sums.filter(F.size("at") == 2).join(F.broadcast(whole)).select(*[F.col("at")[k][c].alias(f"{'of' if c == 'name' else 'is'}{k}") for k in (0, 1) for c in ("name", "value")], "n", (F.col("mean") - F.col("middle")).alias("both"), "rows", "variance")  # one row
    for k in (0, 1):
        two = two.join(side(k), (F.col(f"of{k}") == F.col(f"name{k}")) & F.col(f"is{k}").eqNullSafe(F.col(f"value{k}")))
    two = two.withColumn("effect", F.col("both") - F.col("effect0") - F.col("effect1"))
    share = F.try_divide(F.sum(F.col("n") * F.col("effect") * F.col("effect")), F.first("rows") * F.first("variance")).alias("share")
    singles = one.groupBy(F.col("name").alias("first"), F.lit(None).cast("string").alias("second")).agg(F.count("*").alias("cells"), share)
    pairs = two.groupBy(F.col("of0").alias("first"), F.col("of1").alias("second")).agg(F.count("*").alias("cells"), share)
    return singles.unionAll(pairs)
