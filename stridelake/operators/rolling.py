"""Rebalance calendars, trailing windows and covariance estimates in long form.

A window is the ``lookback`` rows before day t, without day t. Windows are expanded to the days they hold and
joined on the day, so there is no range join; only complete windows exist, as rebalancing starts at t = lookback.
The kernels in ``functions.kernels`` compute the same estimates in stacks; these forms are the checkable ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAMBDA = 0.94


def calendar(days: DataFrame, lookback: int, every: int) -> DataFrame:
    """rb_seq, t_from, t_to of each rebalance; ``days`` has one row with the number of days in ``n_days``."""
    if lookback < 1 or every < 1:
        raise ValueError("lookback and rebalance_every must be at least 1")
    ts = days.where(F.col("n_days") > lookback).select("n_days", F.posexplode(F.sequence(F.lit(lookback), F.col("n_days") - 1, F.lit(every))).alias("rb_seq", "t_from"))
    return ts.select("rb_seq", "t_from", F.least(F.col("t_from") + every, F.col("n_days")).alias("t_to"))


def n_days(returns: DataFrame) -> DataFrame:
    return returns.agg((F.max("t") + 1).cast("int").alias("n_days"))


def windows(returns: DataFrame, lookback: int, every: int) -> DataFrame:
    """rb_seq, age (0 is the newest day), t, asset_idx, r of every window."""
    rebalances = calendar(n_days(returns), lookback, every)
    held = rebalances.select("rb_seq", "t_from", F.explode(F.sequence(F.col("t_from") - lookback, F.col("t_from") - 1)).alias("t"))
    return held.join(returns.select("t", "asset_idx", "r"), "t").select("rb_seq", (F.col("t_from") - 1 - F.col("t")).alias("age"), "t", "asset_idx", "r")


def means(window: DataFrame) -> DataFrame:
    return window.groupBy("rb_seq", "asset_idx").agg(F.avg("r").alias("mu"))


def _pairs(rows: DataFrame, value: str, *more: str) -> DataFrame:
    a = rows.select("rb_seq", "t", F.col("asset_idx").alias("i"), F.col(value).alias("x"), *more)
    b = rows.select("rb_seq", "t", F.col("asset_idx").alias("j"), F.col(value).alias("y"))
    return a.join(b, ["rb_seq", "t"]).where("i <= j")


def mirrored(cov: DataFrame) -> DataFrame:
    """All ordered pairs from those with i <= j."""
    return cov.unionByName(cov.where("i < j").withColumns({"i": F.col("j"), "j": F.col("i")}))


def cov_sample(window: DataFrame) -> DataFrame:
    """rb_seq, i, j, cov for i <= j."""
    return _pairs(window, "r").groupBy("rb_seq", "i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def cov_ewma(window: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """Weights lam**age, renormalised; the weighted mean is taken off first (two passes, for accuracy)."""
    if not 0 < lam < 1:
        raise ValueError(f"lam must be in (0, 1), got {lam}")
    weighted = window.withColumn("w", F.pow(F.lit(lam), F.col("age")))
    series = Window.partitionBy("rb_seq", "asset_idx")
    centred = weighted.withColumn("c", F.col("r") - F.sum(F.col("w") * F.col("r")).over(series) / F.sum("w").over(series))
    return _pairs(centred, "c", "w").groupBy("rb_seq", "i", "j").agg((F.sum(F.expr("w * x * y")) / F.sum("w")).alias("cov"))


def ledoit_wolf(window: DataFrame) -> DataFrame:
    """rb_seq, i, j, cov, alpha for i <= j: the population covariance shrunk towards a scaled identity."""
    series = Window.partitionBy("rb_seq", "asset_idx")
    centred = window.withColumn("c", F.col("r") - F.avg("r").over(series))
    base = _pairs(centred, "c").groupBy("rb_seq", "i", "j").agg(F.avg(F.expr("x * y")).alias("s"), F.avg(F.expr("x * x * y * y")).alias("q"), F.count(F.lit(1)).alias("n"))
    matrix = Window.partitionBy("rb_seq")
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    level = F.avg(F.when(F.col("i") == F.col("j"), F.col("s"))).over(matrix)
    aimed = base.withColumn("target", F.when(F.col("i") == F.col("j"), level).otherwise(0.0))
    summed = aimed.withColumn("pi", F.sum(twice * (F.col("q") - F.col("s") * F.col("s"))).over(matrix)).withColumn("gamma", F.sum(twice * F.pow(F.col("s") - F.col("target"), 2)).over(matrix))
    alpha = F.when(F.col("gamma") < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("pi / if(gamma < 1e-12, 1d, gamma) / n"))))
    return summed.withColumn("alpha", alpha).select("rb_seq", "i", "j", F.expr("(1 - alpha) * s + alpha * target").alias("cov"), "alpha")


ESTIMATORS = {"sample": cov_sample, "ledoit_wolf": lambda w: ledoit_wolf(w).drop("alpha"), "ewma": cov_ewma}


def estimate(window: DataFrame, method: str, **options) -> DataFrame:
    if method not in ESTIMATORS:
        raise ValueError(f"unknown estimator {method!r}; one of {', '.join(ESTIMATORS)}")
    return ESTIMATORS[method](window, **options)


def feasible(window: DataFrame) -> DataFrame:
    """rb_seq, n_positive, feasible: a long-only tangency portfolio needs an asset with a positive mean."""
    return means(window).groupBy("rb_seq").agg(F.sum(F.when(F.col("mu") > 0, 1).otherwise(0)).alias("n_positive")).withColumn("feasible", F.col("n_positive") > 0)
