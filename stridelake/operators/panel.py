"""Cleaning a price panel and turning it into returns. Windows run per asset; only the calendar is ordered as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_MISSING = 0.05


def missing_fraction(prices: DataFrame) -> DataFrame:
    """asset, missing_frac: the share of all dates at which an asset has no price."""
    dates = prices.agg(F.count_distinct("dt").alias("_dates"))
    held = prices.groupBy("asset").agg(F.count("price").alias("_held"))
    return held.crossJoin(F.broadcast(dates)).select("asset", (1 - F.col("_held") / F.col("_dates")).alias("missing_frac"))  # one row


def clean_prices(prices: DataFrame, max_missing: float = MAX_MISSING) -> DataFrame:
    """Drop assets that miss more than ``max_missing`` of the dates, fill forward, drop dates that still have gaps."""
    whole = missing_fraction(prices).where(F.col("missing_frac") <= max_missing).select("asset")
    # Every date with every asset that stays: both sides are distinct key lists.
    grid = prices.select("dt").distinct().crossJoin(whole).join(prices, ["dt", "asset"], "left")
    past = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.withColumn("price", F.last("price", ignorenulls=True).over(past))
    gaps = filled.groupBy("dt").agg(F.max(F.when(F.col("price").isNull(), 1).otherwise(0)).alias("gap")).where("gap = 0")
    return filled.join(gaps.select("dt"), "dt", "left_semi").select("dt", "asset", "price")


def log_returns(prices: DataFrame) -> DataFrame:
    """dt, asset, r: the log of each price over the one before; the first date has none."""
    order = Window.partitionBy("asset").orderBy("dt")
    return prices.select("dt", "asset", F.log(F.col("price") / F.lag("price").over(order)).alias("r")).where(F.col("r").isNotNull())


def arithmetic(r) -> object:
    """Arithmetic from log return."""
    return F.exp(r) - 1


def indexed(returns: DataFrame) -> DataFrame:
    """t, dt, asset_idx, asset, r. Dates and assets are numbered from 0 in order; ties of solvers go by asset number."""
    days = returns.select("dt").distinct().withColumn("t", F.row_number().over(Window.orderBy("dt")) - 1)
    assets = returns.select("asset").distinct().withColumn("asset_idx", F.row_number().over(Window.orderBy("asset")) - 1)
    return returns.join(days, "dt").join(assets, "asset").select("t", "dt", "asset_idx", "asset", "r")


def equal_weight(returns: DataFrame) -> DataFrame:
    """Arithmetic return of the equal-weight portfolio: exp of the mean log return, less 1. Keys besides the asset are kept."""
    keys = [c for c in returns.columns if c not in ("asset", "asset_idx", "r")]
    return returns.groupBy(*keys).agg((F.exp(F.avg("r")) - 1).alias("port_ret"))


def slice_rows(returns: DataFrame, last: int | None = None, first_assets: int | None = None) -> DataFrame:
    """The last ``last`` days and the first ``first_assets`` assets of indexed returns."""
    out = returns
    if last is not None:
        end = returns.agg((F.max("t") - last).alias("_end"))
        out = out.join(F.broadcast(end), F.col("t") > F.col("_end")).drop("_end")
    return out if first_assets is None else out.where(F.col("asset_idx") < first_assets)


def suspicious(returns: DataFrame, most: float = 0.5) -> DataFrame:
    """Rows that aren't finite or whose size isn't below ``most``."""
    return returns.where(F.isnan("r") | F.col("r").isNull() | (F.abs("r") >= most))


def lag1_autocorrelation(series: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return series.withColumn("_before", F.lag(value).over(w)).where(F.col("_before").isNotNull()).groupBy(*keys).agg(F.corr(value, "_before").alias("acf"))
