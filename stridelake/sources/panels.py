"""Price panels: long DataFrames (dt timestamp_ntz, asset string, price double)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Panel -> (asset column, bucket).
LINEITEM_PANELS = {"brand_week": ("p_brand", "week"), "type_day": ("p_type", "day"), "type_week": ("p_type", "week")}
PANELS = (*LINEITEM_PANELS, "event_day")


def bucket(unit: str, column: str):
    return F.date_trunc(unit, column).cast("timestamp_ntz")


def price_panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Mean price of each asset and bucket. Scans two or three columns; aggregates partially before its only large shuffle."""
    if name == "event_day":
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        return events.groupBy(bucket("day", "ts").alias("dt"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("price"))
    if name not in LINEITEM_PANELS:
        raise ValueError(f"unknown panel {name!r}; one of {', '.join(PANELS)}")
    column, unit = LINEITEM_PANELS[name]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(column).alias("asset"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(bucket(unit, "l_shipdate").alias("dt"), "asset").agg(F.avg("unit_price").alias("price"))


def long_panel(wide: DataFrame, dt: str = "dt") -> DataFrame:
    """One row per date and asset from a frame with one column per asset."""
    assets = [c for c in wide.columns if c != dt]
    return wide.unpivot([dt], assets, "asset", "price").withColumnRenamed(dt, "dt").withColumn("price", F.col("price").cast("double"))


def wide_panel(panel: DataFrame, assets: list[str], value: str = "price") -> DataFrame:
    """One column per asset; the asset list is given, so no extra pass finds it."""
    return panel.groupBy("dt").pivot("asset", assets).agg(F.first(value))


def panel_key(**parameters: object) -> str:
    """The name of a stored panel: it changes with every parameter, so a stored panel is never a stale one."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def stored(spark: SparkSession, folder: str, build, refresh: bool = False, **parameters: object) -> DataFrame:
    """Read the panel that ``build()`` gave for these parameters, or build and write it first."""
    path = f"{folder.rstrip('/')}/{panel_key(**parameters)}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report table as CSV with a header, one file: reports have a row per configuration."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def gaussian_returns(spark: SparkSession, days: int, assets: int, scale: float = 0.01, seed: int = 42) -> DataFrame:
    """Synthetic normal returns (t, asset_idx, r)."""
    return spark.range(days * assets).select((F.col("id") / assets).cast("int").alias("t"), (F.col("id") % assets).cast("int").alias("asset_idx"), (F.randn(seed) * scale).alias("r"))


def arithmetic_returns(spark: SparkSession, days: int, assets: int, scale: float = 0.01, seed: int = 42) -> DataFrame:
    """Synthetic normal returns (t, asset_idx, r) whose draws are arithmetic in the row number (Box and Muller), so that any engine can repeat them."""
    draw = lambda step: f"((id * 1103515245 + 12345 * {step} + {seed}) % 2147483648 + 0.5D) / 2147483648D"
    normal = F.expr(f"{scale}D * sqrt(-2 * ln({draw(1)})) * cos(2 * pi() * {draw(7919)})")
    return spark.range(days * assets).select((F.col("id") / assets).cast("int").alias("t"), (F.col("id") % assets).cast("int").alias("asset_idx"), normal.alias("r"))


def write_json(df: DataFrame, path: str) -> None:
    """A small table as JSON lines, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
