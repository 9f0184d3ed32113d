"""Strategy configurations and their checks."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from .kernels import ESTIMATORS as KNOWN
from .kernels import LAMBDA

ESTIMATORS = ("sample", "ledoit_wolf", "ewma")
OBJECTIVES = ("min_variance", "max_sharpe")
STEPS = ("exact", "power")
CONFIG_SCHEMA = "config_idx int, estimator string, objective string, lookback int, rebalance_every int, long_only boolean, rf_annual double, lam double, step string, label string"


@dataclass(frozen=True)
class Config:
    """``lam`` is an option of estimators (ewma's decay); ``step`` is how the minimum-variance step size is found."""

    estimator: str = "ledoit_wolf"
    objective: str = "min_variance"
    lookback: int = 252
    rebalance_every: int = 21
    long_only: bool = True
    rf_annual: float = 0.0
    lam: float = LAMBDA
    step: str = "exact"

    def __post_init__(self) -> None:
        if self.estimator not in KNOWN:
            raise ValueError(f"unknown estimator {self.estimator!r}; one of {', '.join(KNOWN)}")
        if not 0 < self.lam < 1:
            raise ValueError(f"lam must be in (0, 1), got {self.lam}")
        if self.step not in STEPS:
            raise ValueError(f"unknown step {self.step!r}; one of {', '.join(STEPS)}")
        if self.objective not in OBJECTIVES:
            raise ValueError(f"unknown objective {self.objective!r}; one of {', '.join(OBJECTIVES)}")
        if self.lookback < 2 or self.rebalance_every < 1:
            raise ValueError("lookback must be at least 2 and rebalance_every at least 1")

    @property
    def label(self) -> str:
        return f"{self.estimator}|{self.objective}|lb={self.lookback}|rb={self.rebalance_every}"


def grid(estimators: Iterable[str] = ESTIMATORS, objectives: Iterable[str] = OBJECTIVES, lookbacks: Iterable[int] = (63, 252, 504), rebalances: Iterable[int] = (5, 21, 63)) -> list[Config]:
    """All combinations; the nesting order numbers them."""
    return [Config(*x) for x in itertools.product(estimators, objectives, lookbacks, rebalances)]


def config_frame(spark: SparkSession, configs: list[Config], indices: list[int] | None = None) -> DataFrame:
    """One row a configuration. Its number is data: filtering the frame doesn't renumber, and seeds depend on it."""
    numbers = indices if indices is not None else range(len(configs))
    return spark.createDataFrame([(i, *asdict(c).values(), c.label) for i, c in zip(numbers, configs)], CONFIG_SCHEMA)


def check_workload(n_days: int, configs: list[Config], n_bootstrap: int, block_size: int) -> None:
    if n_days < 2:
        raise ValueError(f"need at least 2 days of returns, got {n_days}")
    if n_bootstrap < 1:
        raise ValueError("n_bootstrap must be at least 1")
    if not 1 <= block_size <= n_days:
        raise ValueError(f"block_size must be in [1, {n_days}], got {block_size}")
    for c in configs:
        if c.lookback >= n_days:
            raise ValueError(f"lookback {c.lookback} leaves nothing of {n_days} days to trade on")
