"""What a run took: the machine, speedups, projections, profiles. Times come from the caller; nothing here runs a workload but ``profile`` and ``sweep``."""

from __future__ import annotations

import json
import os
import platform
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hardware(spark: SparkSession) -> dict[str, object]:
    """A record of the driver's machine and of the cluster's size."""
    try:
        memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError):
        memory = None
    return {"machine": platform.machine(), "system": platform.system(), "python": platform.python_version(), "spark": spark.version, "cores": os.cpu_count(), "memory_bytes": memory, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism}


def write_record(record: dict, path: str) -> None:
    """A record as a JSON file on the driver."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(record, out, indent=1, sort_keys=True)


def warm_up(spark: SparkSession) -> None:
    """Start a Python worker on every core and load the kernels there, so that no timed run pays for it."""

    def load(batches):
        from ..functions import kernels  # noqa: F401

        yield from batches

    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).mapInPandas(load, "id long").write.format("noop").mode("overwrite").save()


def speedups(times: DataFrame, workers: str = "workers", seconds: str = "seconds") -> DataFrame:
    """``times`` with speedup against the run with the fewest workers, and efficiency, the speedup a worker of that run."""
    first = times.agg(F.min(F.struct(workers, seconds)).alias("_first"))
    out = times.crossJoin(F.broadcast(first))  # one row
    return out.withColumn("speedup", F.col(f"_first.{seconds}") / F.col(seconds)).withColumn("efficiency", F.col("speedup") * F.col(f"_first.{workers}") / F.col(workers)).drop("_first")


def projected(times: DataFrame, measured: int, wanted: int, seconds: str = "seconds") -> DataFrame:
    """``times`` with the seconds that ``wanted`` tasks would take at the rate of the ``measured`` ones."""
    if measured < 1:
        raise ValueError("nothing was measured")
    return times.withColumn("projected", F.col(seconds) / measured * wanted)


def sweep(values: Iterable[int], run: Callable[[int], object]) -> list[tuple[int, float]]:
    """(value, seconds) of a run at each value: numbers of workers, replicates or the like."""
    out = []
    for value in values:
        begin = time.perf_counter()
        run(value)
        out.append((value, time.perf_counter() - begin))
    return out


def profile(df: DataFrame, path: str | None = None) -> str:
    """A text report of a query: its formatted plan as it ran, and seconds. Written to ``path`` on the driver if given."""
    begin = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - begin
    report = f"seconds {took:.3f}\n" + df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    if path:
        with open(path, "w", encoding="utf-8") as out:
            out.write(report)
    return report
