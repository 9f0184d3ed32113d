"""Portfolios in long form: weights (rb_seq, asset_idx, w), their returns, risk and optimality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rolling import mirrored

JITTER = 1e-10
ACTIVE = 1e-6


def project_simplex(vectors: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, asset_idx, w: the nearest point of the unit simplex (Duchi et al., 2008), by one sort a vector."""
    down = Window.partitionBy(*keys).orderBy(F.desc(value), "asset_idx")
    ranked = vectors.withColumn("_i", F.row_number().over(down)).withColumn("_c", (F.sum(value).over(down.rowsBetween(Window.unboundedPreceding, 0)) - 1) / F.col("_i"))
    tau = F.max(F.when(F.col(value) - F.col("_c") > 0, F.struct("_i", "_c"))).over(Window.partitionBy(*keys))
    return ranked.withColumn("_tau", tau).select(*keys, "asset_idx", F.greatest(F.col(value) - F.col("_tau._c"), F.lit(0.0)).alias("w"))


def two_asset_min_variance(cov: DataFrame, a: int = 0, b: int = 1) -> DataFrame:
    """rb_seq, w1, w2: long/short closed form."""
    c = _two(cov, a, b)
    total = F.expr("c11 + c22 - 2 * c12")
    return c.select("rb_seq", F.expr("c22 - c12").alias("z1"), F.expr("c11 - c12").alias("z2"), total.alias("z")).select("rb_seq", F.try_divide("z1", "z").alias("w1"), F.try_divide("z2", "z").alias("w2"))


def two_asset_tangency(cov: DataFrame, mu: DataFrame, a: int = 0, b: int = 1) -> DataFrame:
    """rb_seq, w1, w2: long/short closed form; null where the weights don't sum to anything."""
    m = mu.where(F.col("asset_idx").isin(a, b)).groupBy("rb_seq").agg(F.max(F.when(F.col("asset_idx") == a, F.col("mu"))).alias("m1"), F.max(F.when(F.col("asset_idx") == b, F.col("mu"))).alias("m2"))
    z = _two(cov, a, b).join(m, "rb_seq").select("rb_seq", F.expr("c22 * m1 - c12 * m2").alias("z1"), F.expr("c11 * m2 - c12 * m1").alias("z2"))
    return z.select("rb_seq", F.try_divide(F.col("z1"), F.col("z1") + F.col("z2")).alias("w1"), F.try_divide(F.col("z2"), F.col("z1") + F.col("z2")).alias("w2"))


def _two(cov: DataFrame, a: int, b: int) -> DataFrame:
    pick = lambda i, j, extra: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("cov") + extra))
    return cov.where(F.col("i").isin(a, b) & F.col("j").isin(a, b)).groupBy("rb_seq").agg(pick(a, a, JITTER).alias("c11"), pick(a, b, 0.0).alias("c12"), pick(b, b, JITTER).alias("c22"))


def inverse_variance(cov: DataFrame) -> DataFrame:
    """rb_seq, asset_idx, w in proportion to 1 / variance."""
    inverse = cov.where("i = j").select("rb_seq", F.col("i").alias("asset_idx"), (1 / F.col("cov")).alias("x"))
    return inverse.withColumn("w", F.col("x") / F.sum("x").over(Window.partitionBy("rb_seq"))).select("rb_seq", "asset_idx", "w")


def hold(returns: DataFrame, weights: DataFrame, lookback: int, every: int) -> DataFrame:
    """t, port_ret: each day's arithmetic return at the weights of the latest rebalance, which the day's number tells."""
    days = returns.where(F.col("t") >= lookback).withColumn("rb_seq", F.expr(f"cast((t - {lookback}) div {every} as int)"))
    return days.join(weights, ["rb_seq", "asset_idx"]).groupBy("t").agg(F.sum(F.col("w") * (F.exp("r") - 1)).alias("port_ret"))


def hold_asof(returns: DataFrame, weights: DataFrame, spans: DataFrame) -> DataFrame:
    """As ``hold`` for any calendar: ``spans`` has rb_seq, t_from, t_to, each expanded to its days."""
    days = spans.select("rb_seq", F.explode(F.sequence("t_from", F.col("t_to") - 1)).alias("t"))
    return days.join(returns, "t").join(weights, ["rb_seq", "asset_idx"]).groupBy("t").agg(F.sum(F.col("w") * (F.exp("r") - 1)).alias("port_ret"))


def variance(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """rb_seq, var = w' C w."""
    a = weights.select("rb_seq", F.col("asset_idx").alias("i"), F.col("w").alias("wi"))
    b = weights.select("rb_seq", F.col("asset_idx").alias("j"), F.col("w").alias("wj"))
    return mirrored(cov.select("rb_seq", "i", "j", "cov")).join(a, ["rb_seq", "i"]).join(b, ["rb_seq", "j"]).groupBy("rb_seq").agg(F.sum(F.expr("wi * cov * wj")).alias("var"))


def sharpe(weights: DataFrame, cov: DataFrame, mu: DataFrame) -> DataFrame:
    """rb_seq, sharpe per period of the weights."""
    ret = weights.join(mu, ["rb_seq", "asset_idx"]).groupBy("rb_seq").agg(F.sum(F.col("w") * F.col("mu")).alias("ret"))
    return variance(weights, cov).join(ret, "rb_seq").select("rb_seq", F.when(F.col("var") > 0, F.col("ret") / F.sqrt("var")).alias("sharpe"))


def invariants(weights: DataFrame) -> DataFrame:
    return weights.groupBy("rb_seq").agg(F.sum("w").alias("sum_w"), F.min("w").alias("min_w"), F.sum(F.when(F.col("w") > ACTIVE, 1).otherwise(0)).alias("n_active"))


def kkt(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """rb_seq, spread of the active assets' gradients C w, and inactive_excess: how far an inactive one lies below their mean."""
    b = weights.select("rb_seq", F.col("asset_idx").alias("j"), F.col("w").alias("wj"))
    gradient = mirrored(cov.select("rb_seq", "i", "j", "cov")).join(b, ["rb_seq", "j"]).groupBy("rb_seq", F.col("i").alias("asset_idx")).agg(F.sum(F.expr("cov * wj")).alias("g"))
    rows = weights.join(gradient, ["rb_seq", "asset_idx"]).withColumn("on", F.col("w") > ACTIVE)
    found = rows.groupBy("rb_seq").agg(
        (F.max(F.when(F.col("on"), F.col("g"))) - F.min(F.when(F.col("on"), F.col("g")))).alias("spread"), F.avg(F.when(F.col("on"), F.col("g"))).alias("level"), F.min(F.when(~F.col("on"), F.col("g"))).alias("least")
    )
    return found.select("rb_seq", "spread", F.coalesce(F.greatest(F.col("level") - F.col("least"), F.lit(0.0)), F.lit(0.0)).alias("inactive_excess"))
