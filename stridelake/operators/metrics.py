"""Performance metrics of return series. An undefined metric is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIODS = 252
METRICS = ("annual_return", "annual_vol", "sharpe", "max_drawdown", "cagr")


def _order(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def drawdowns(series: DataFrame, keys: list[str], order: str = "t", value: str = "port_ret", log: bool = False) -> DataFrame:
    """wealth, peak and drawdown along each series. The first peak is the wealth after the first period, not 1."""
    past = _order(keys, order)
    wealth = F.exp(F.sum(value).over(past)) if log else F.product(1 + F.col(value)).over(past)
    peaked = series.withColumn("wealth", wealth).withColumn("peak", F.max("wealth").over(past))
    return peaked.withColumn("drawdown", (F.col("wealth") - F.col("peak")) / F.col("peak"))


def _growth(total: Column, n: Column, periods: int) -> Column:
    return F.when(total > 0, F.pow(total, F.lit(float(periods)) / n) - 1)


def metric_summary(series: DataFrame, keys: list[str], order: str = "t", value: str = "port_ret", rf_annual: float | Column = 0.0, periods: int = PERIODS, log: bool = False) -> DataFrame:
    """The five metrics of each series, from one sort per key and one aggregation."""
    rows = drawdowns(series, keys, order, value, log)
    total = F.exp(F.sum(value)) if log else F.product(1 + F.col(value))
    rf = rf_annual if isinstance(rf_annual, Column) else F.lit(float(rf_annual))
    found = rows.groupBy(*keys).agg(
        (F.avg(value) * periods).alias("annual_return"),
        (F.stddev_samp(value) * F.sqrt(F.lit(float(periods)))).alias("annual_vol"),
        F.min("drawdown").alias("max_drawdown"),
        _growth(total, F.count(value), periods).alias("cagr"),
        F.first(rf).alias("_rf"),
    )
    sharpe = F.when(F.col("annual_vol") >= 1e-10, (F.col("annual_return") - F.col("_rf")) / F.col("annual_vol"))
    return found.withColumn("sharpe", sharpe).select(*keys, *METRICS)


def undefined_to_null(df: DataFrame, columns: tuple[str, ...] = METRICS) -> DataFrame:
    """Kernels give NaN for undefined metrics; SQL aggregates skip nulls, not NaN."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def summarise(raw: DataFrame, keys: list[str], columns: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and exact, interpolated 5 % and 95 % quantiles over replicates, undefined values left out."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, 0.05).alias(f"{c}_p05"), F.percentile(c, 0.95).alias(f"{c}_p95")]
    return raw.groupBy(*keys).agg(*aggs)


def strategy_report(raw: DataFrame) -> DataFrame:
    """Per strategy, sorted by its fields. Quantiles are undefined where any value is, means skip undefined values."""
    keys = ["label", "estimator", "objective", "lookback", "rebalance_every"]
    whole = F.count("sharpe") == F.count(F.lit(1))
    return (
        raw.groupBy(*keys)
        .agg(
            F.avg("sharpe").alias("sharpe_mean"),
            F.when(whole, F.percentile("sharpe", 0.05)).alias("sharpe_p05"),
            F.when(whole, F.percentile("sharpe", 0.95)).alias("sharpe_p95"),
            F.avg("annual_vol").alias("annual_vol_mean"),
            F.avg("max_drawdown").alias("max_dd_mean"),
            F.avg("cagr").alias("cagr_mean"),
        )
        .orderBy(*keys)
    )


def max_abs_diff(a: DataFrame, b: DataFrame, keys: list[str], columns: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, max_diff of two result sets; a key that only one of them has makes every max_diff infinite."""
    both = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_in_a")).join(b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_in_b")), keys, "full_outer")
    alone = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    worst = both.agg(*[F.max(F.when(alone, float("inf")).otherwise(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")))).alias(c) for c in columns])
    return worst.unpivot([], list(columns), "metric", "max_diff")


def worst_differences(a: DataFrame, b: DataFrame, keys: list[str], column: str, k: int = 5) -> DataFrame:
    """The k keys whose values differ most, relative to the first."""
    both = a.select(*keys, F.col(column).alias("_a")).join(b.select(*keys, F.col(column).alias("_b")), keys)
    return both.withColumn("rel_diff", F.abs(F.col("_a") - F.col("_b")) / F.greatest(F.abs("_a"), F.lit(1e-12))).drop("_a", "_b").orderBy(F.desc_nulls_last("rel_diff"), *keys).limit(k)


def top_and_bottom(raw: DataFrame, column: str = "sharpe", key: str = "config_idx", k: int = 5) -> DataFrame:
    """The k best and the k worst rows, ties by key, with their side. Each is a bounded top-k, not a sort of all rows."""
    best = raw.where(F.col(column).isNotNull()).orderBy(F.desc(column), key).limit(k).withColumn("side", F.lit("top"))
    worst = raw.where(F.col(column).isNotNull()).orderBy(F.asc(column), key).limit(k).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)
