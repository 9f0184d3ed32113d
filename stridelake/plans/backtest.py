"""Backtests and bootstrap workloads: tasks are rows, the return matrix travels once, kernels run on stacks.

The return matrix (days x assets) is broadcast; its size is checked. Tasks (configuration x replicate) are dealt
evenly over partitions, each partition's rows reach Python in Arrow batches, and a replicate's rebalances are solved in one stack.
Filters on configurations belong on the task table, before the kernel: no predicate goes through it.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.config import Config, check_workload, config_frame
from ..operators.metrics import METRICS, summarise, undefined_to_null
from ..session import checkpointed
from ..sources.panels import stored

#: Most bytes of a return matrix that is sent to every executor.
MOST_MATRIX_BYTES = 512 * 1024 * 1024
KEYS = ["config_idx", "estimator", "objective", "lookback", "rebalance_every", "label"]
RAW_SCHEMA = "config_idx int, bootstrap_idx int, estimator string, objective string, lookback int, rebalance_every int, label string, " + ", ".join(f"{m} double" for m in METRICS) + ", status string"


@dataclass(frozen=True)
class Workload:
    """Lazy results of a bootstrap workload."""

    raw_metrics: DataFrame
    metrics_per_config: DataFrame


def return_matrix(returns: DataFrame) -> np.ndarray:
    """Days x assets from indexed returns (t, asset_idx, r); the driver checks the size before it gets any row, and gets one
    array a day. A larger panel is solved from windows that stay distributed: ``operators.rolling`` and ``solve_stack``."""
    days, assets, cells = returns.agg(F.max("t") + 1, F.max("asset_idx") + 1, F.count("r")).first()
    if days is None:
        return np.zeros((0, 0))
    if days * assets * 8 > MOST_MATRIX_BYTES:
        raise ValueError(f"a return matrix of {days} x {assets} is too large to send to every executor")
    if cells != days * assets:
        raise ValueError("the panel has gaps; clean_prices() fills or drops them")
    rows = returns.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("asset_idx", "r"))).alias("x")).select("t", F.transform("x", lambda x: x["r"]).alias("r")).toArrow()
    lists = rows.column("r").combine_chunks()
    out = np.empty((days, assets))
    out[rows.column("t").to_numpy()] = lists.values.to_numpy().reshape(days, assets)
    return out


def tasks(spark: SparkSession, configs: DataFrame, n_bootstrap: int, seed: int = 0) -> DataFrame:
    """Configurations x replicates with their seeds."""
    if n_bootstrap > 997:
        warnings.warn("seeds of neighbouring configurations collide beyond 997 replicates", stacklevel=2)
    replicas = spark.range(n_bootstrap).select(F.col("id").cast("int").alias("bootstrap_idx"))
    return configs.crossJoin(replicas).withColumn("sub_seed", F.lit(seed).cast("long") * 1000003 + F.col("config_idx").cast("long") * 997 + F.col("bootstrap_idx"))


def _dealt(spark: SparkSession, rows: DataFrame, n: int) -> DataFrame:
    """Single tasks dealt round by number, the dear ones apart: three partitions a core."""
    return rows.repartitionByRange(max(1, min(n, 3 * spark.sparkContext.defaultParallelism)), F.hash("bootstrap_idx", "config_idx"))


def _estimators() -> dict:
    """What is registered here, to travel to the workers by value."""
    return dict(kernels.ESTIMATORS)


def _solve(returns: np.ndarray, row: object, known: dict) -> tuple[np.ndarray, np.ndarray]:
    return kernels.weights_for(returns, known[row.estimator], row.objective, row.lookback, row.rebalance_every, row.long_only, lam=row.lam, step=row.step)


def _sample(returns: np.ndarray, row: object, mode: str, block: float) -> np.ndarray:
    if mode == "none":
        return returns
    if mode == "arithmetic":
        return returns[kernels.arithmetic_blocks(row.bootstrap_idx, len(returns), block)]
    draw = kernels.fixed_blocks if mode == "fixed" else kernels.stationary_blocks
    return returns[draw(np.random.default_rng(int(row.sub_seed)), len(returns), block)]


def raw_metrics(spark: SparkSession, matrix: np.ndarray, task_rows: DataFrame, n_tasks: int, mode: str = "fixed", block: float = 20, strict: bool = False) -> DataFrame:
    """One row a task with its metrics; a task with an infeasible rebalance has null metrics and says so, or raises if ``strict``."""
    held, known = spark.sparkContext.broadcast(matrix), _estimators()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        returns = held.value
        for batch in batches:
            out = []
            for row in batch.itertuples():
                sample = _sample(returns, row, mode, block)
                w, ok = _solve(sample, row, known)
                if strict and not ok.all():
                    raise ValueError(f"{row.label}, replicate {row.bootstrap_idx}: no asset has a positive mean excess return")
                found = kernels.metrics(kernels.held_returns(sample, w, row.lookback, row.rebalance_every) if ok.all() else np.zeros(0), row.rf_annual)
                out.append((row.config_idx, row.bootstrap_idx, row.estimator, row.objective, row.lookback, row.rebalance_every, row.label, *[found[m] for m in METRICS], "ok" if ok.all() else "infeasible"))
            yield pd.DataFrame(out, columns=["config_idx", "bootstrap_idx", *KEYS[1:5], "label", *METRICS, "status"])

    return undefined_to_null(_dealt(spark, task_rows, n_tasks).mapInPandas(run, RAW_SCHEMA))


def bootstrap(
    spark: SparkSession, returns: DataFrame, configs: list[Config], n_bootstrap: int = 50, block_size: int = 20, seed: int = 0, mode: str = "fixed", indices: list[int] | None = None, strict: bool = False, store: str | None = None
) -> Workload:
    """The bootstrap workload: every configuration on every resample, and per-configuration summaries.

    ``mode`` is fixed, stationary, arithmetic (draws that any engine can repeat; ``seed`` isn't used) or none. With a ``store`` folder the raw metrics are
    kept there under a key of the returns and all parameters, and a later call with the same reads them instead of solving again.
    """
    matrix = return_matrix(returns)
    check_workload(len(matrix), configs, n_bootstrap, block_size)
    rows = tasks(spark, config_frame(spark, configs, indices), n_bootstrap, seed)

    def solve() -> DataFrame:
        return raw_metrics(spark, matrix, rows, len(configs) * n_bootstrap, mode, block_size, strict)

    if store:
        data = hashlib.sha256(np.ascontiguousarray(matrix).tobytes()).hexdigest()
        raw = stored(spark, store, solve, data=data, configs=[str(c) for c in configs], n_bootstrap=n_bootstrap, block_size=block_size, seed=seed, mode=mode, indices=indices, strict=strict)
    else:
        raw = solve()
    return Workload(raw, summarise(raw, KEYS))


def backtest(spark: SparkSession, returns: DataFrame, configs: list[Config], indices: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, daily returns) of every configuration on the panel itself; both read one solution, which is computed here.

    weights: config_idx, rb_seq, t_from, status, w array<double> (null if infeasible); daily: config_idx, t, port_ret.
    """
    matrix = return_matrix(returns)
    check_workload(len(matrix), configs, 1, 1)
    held, known = spark.sparkContext.broadcast(matrix), _estimators()
    rows = _dealt(spark, config_frame(spark, configs, indices).withColumn("bootstrap_idx", F.lit(0)), len(configs))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                w, ok = _solve(held.value, row, known)
                r = kernels.held_returns(held.value, w, row.lookback, row.rebalance_every)
                days = kernels.rebalance_days(len(held.value), row.lookback, row.rebalance_every)
                spans = [r[a - row.lookback : a - row.lookback + row.rebalance_every] for a in days]
                yield pd.DataFrame({"config_idx": row.config_idx, "rb_seq": range(len(days)), "t_from": days, "status": np.where(ok, "ok", "infeasible"), "w": [x if good else None for x, good in zip(w, ok)], "r": spans})

    solved = checkpointed(rows.mapInPandas(solve, "config_idx int, rb_seq int, t_from int, status string, w array<double>, r array<double>"))
    daily = solved.select("config_idx", "t_from", F.posexplode("r").alias("k", "port_ret")).select("config_idx", (F.col("t_from") + F.col("k")).alias("t"), F.when(~F.isnan("port_ret"), F.col("port_ret")).alias("port_ret"))
    return solved.drop("r"), daily


def solve_stack(problems: DataFrame, objective: str = "min_variance", long_only: bool = True, steps: int | None = None) -> DataFrame:
    """key, w, status for rows (key, n, cov array<double> of n*n, mu array<double>): batches of equal n are solved as one stack."""
    kind = problems.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby("n"):
                cov = np.stack(part["cov"].to_numpy()).reshape(-1, n, n)
                if objective == "optimum":  # with gains in mu: all 1 for minimum variance
                    w = np.stack([kernels.optimum(c, np.asarray(g, float)) for c, g in zip(cov, part["mu"])])
                    ok = ~np.isnan(w).any(axis=1)
                elif objective == "min_variance":
                    w, ok = kernels.min_variance(cov, long_only, steps or kernels.MIN_VARIANCE_STEPS), np.ones(len(cov), bool)
                else:
                    w, ok = kernels.max_sharpe(cov, np.stack(part["mu"].to_numpy()), long_only, steps or kernels.MAX_SHARPE_STEPS)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "w": [x if good else None for x, good in zip(w, ok)], "status": np.where(ok, "ok", "infeasible")})

    return problems.mapInPandas(run, f"key {kind}, w array<double>, status string")


def eigen_diagnostics(spark: SparkSession, returns: DataFrame, estimator: str = "sample", lookback: int = 63, every: int = 21) -> DataFrame:
    """key (rebalance number), min_eig, max_eig, power_eig, cond of the window covariances."""
    matrix = return_matrix(returns)
    held, known = spark.sparkContext.broadcast(matrix), _estimators()
    n = len(kernels.rebalance_days(len(matrix), lookback, every))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = batch["key"].to_numpy()
                x = np.stack([held.value[lookback + k * every - lookback : lookback + k * every] for k in keys])
                cov = known[estimator](x)
                low, high, cond = kernels.eigen_range(cov)
                yield pd.DataFrame({"key": keys, "min_eig": low, "max_eig": high, "power_eig": kernels.top_eigenvalue(cov, "power"), "cond": cond})

    return spark.range(n).select(F.col("id").cast("int").alias("key")).mapInPandas(run, "key int, min_eig double, max_eig double, power_eig double, cond double")


def frank_wolfe_trace(spark: SparkSession, returns: DataFrame, estimator: str = "sample", lookback: int = 63, every: int = 21, steps: int = 20) -> DataFrame:
    """rb_seq, k, best, vol, ret, grad_max of the first solver steps at each rebalance."""
    matrix = return_matrix(returns)
    held, known = spark.sparkContext.broadcast(matrix), _estimators()
    n = len(kernels.rebalance_days(len(matrix), lookback, every))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["rb_seq"]:
                x = held.value[k * every : k * every + lookback]
                rows = kernels.frank_wolfe_trace(known[estimator](x[None])[0], x.mean(axis=0), steps)
                yield pd.DataFrame([(k, *r) for r in rows], columns=["rb_seq", "k", "best", "vol", "ret", "grad_max"])

    return spark.range(n).select(F.col("id").cast("int").alias("rb_seq")).mapInPandas(run, "rb_seq int, k int, best int, vol double, ret double, grad_max double")
