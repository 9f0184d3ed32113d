"""Session helpers: the settings the engine relies on, and the folder it may share between executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Kernels are batched over problems, so one BLAS thread per Python worker is right.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a session in one process may fall back to a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stridelake-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, however many branches of a query read it; removed with its last reference."""
    folder, context = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def build_session(app: str = "stridelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` (dots written as ``__``) overrides them."""
    builder = SparkSession.builder.appName(app).config(map=ENGINE_CONF)
    if master:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
