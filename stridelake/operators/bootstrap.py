"""Block-bootstrap index tables (boot, pos, src_t) and the resamples they make.

The index table is what travels; B x T x N returns are never written. Draws are arithmetic in the indices, so
any engine can repeat them; the kernels in ``plans.backtest`` draw from NumPy generators instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODULUS = 2147483648


def _check(n_boot: int, block: float) -> None:
    if n_boot < 1 or block < 1:
        raise ValueError("n_bootstrap and the block size must be at least 1")


def fixed_index(days: DataFrame, n_boot: int, block: int = 20, seed: int = 42) -> DataFrame:
    """Blocks of ``block`` consecutive days from arithmetic starts, cut at n_days."""
    _check(n_boot, block)
    blocks = days.withColumn("n_blocks", F.expr(f"cast((n_days + {block} - 1) div {block} as int)")).crossJoin(days.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("boot")))
    if days.where(F.col("n_days") < block).head(1):
        raise ValueError(f"block size {block} exceeds the number of days")
    starts = blocks.select("boot", "n_days", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("blk"))
    start = F.expr(f"((cast(boot as bigint) * 1103515245 + cast(blk as bigint) * 12345 + {seed}) % {MODULUS}) % (n_days - {block} + 1)")
    steps = starts.withColumn("start", start).select("boot", "n_days", "blk", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("off"))
    return steps.select("boot", F.expr(f"blk * {block} + off").alias("pos"), (F.col("start") + F.col("off")).cast("int").alias("src_t"), "n_days").where("pos < n_days").drop("n_days")


def iid_index(days: DataFrame, n_boot: int, seed: int = 42) -> DataFrame:
    return fixed_index(days, n_boot, 1, seed)


def stationary_index(days: DataFrame, n_boot: int, mean_block: float = 20.0, seed: int = 42) -> DataFrame:
    """Politis-Romano: a new start with probability 1 / mean_block, else the next day, going round at the end."""
    _check(n_boot, mean_block)
    steps = days.crossJoin(days.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("boot"))).select("boot", "n_days", F.explode(F.sequence(F.lit(0), F.col("n_days") - 1)).alias("pos"))
    u = F.expr(f"((cast(boot as bigint) * 1103515245 + cast(pos as bigint) * 69069 * 7919 + {seed}) % {MODULUS}) / {float(MODULUS)}D")
    drawn = steps.withColumn("new", (F.col("pos") == 0) | (u < 1.0 / mean_block)).withColumn("start", F.expr(f"((cast(boot as bigint) * 22695477 + cast(pos as bigint) * 1664525 + 1013904223 + {seed}) % {MODULUS}) % n_days"))
    past = Window.partitionBy("boot").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("new"), F.struct("pos", "start")), ignorenulls=True).over(past)
    return drawn.withColumn("_b", last).select("boot", "pos", F.expr("cast((_b.start + pos - _b.pos) % n_days as int)").alias("src_t"))


def gather(index: DataFrame, returns: DataFrame) -> DataFrame:
    """boot, pos, asset_idx, asset, r: whole days are resampled, so assets stay together."""
    return index.join(returns.select(F.col("t").alias("src_t"), "asset_idx", "asset", "r"), "src_t").select("boot", "pos", "asset_idx", "asset", "r")


def moments(sample: DataFrame) -> DataFrame:
    return sample.groupBy("asset").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std_pop"))
