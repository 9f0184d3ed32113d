"""NumPy kernels over stacks of problems: (K, N, N) covariances at once, never one matrix a call."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Matrices that are solved together: what a core's cache holds.
BLOCK_BYTES = 4 << 20
PERIODS, LAMBDA, JITTER = 252, 0.94, 1e-10
MIN_VARIANCE_STEPS, MAX_SHARPE_STEPS = 500, 5000


def rebalance_days(n_days: int, lookback: int, every: int) -> np.ndarray:
    return np.arange(lookback, n_days, every)


def window_stack(returns: np.ndarray, lookback: int, every: int) -> np.ndarray:
    """(K, lookback, N): the rows before each rebalance day; a view."""
    days = rebalance_days(len(returns), lookback, every)
    return np.lib.stride_tricks.sliding_window_view(returns, lookback, axis=0)[days - lookback].transpose(0, 2, 1)


def cov_sample(x: np.ndarray) -> np.ndarray:
    c = x - x.mean(axis=1, keepdims=True)
    return c.transpose(0, 2, 1) @ c / (x.shape[1] - 1)


def cov_ledoit_wolf(x: np.ndarray) -> np.ndarray:
    n_obs, n = x.shape[1:]
    c = x - x.mean(axis=1, keepdims=True)
    base = c.transpose(0, 2, 1) @ c / n_obs
    level = np.trace(base, axis1=1, axis2=2) / n
    target = level[:, None, None] * np.eye(n)
    square = c * c
    spread = (square.transpose(0, 2, 1) @ square / n_obs - base * base).sum(axis=(1, 2))
    distance = ((base - target) ** 2).sum(axis=(1, 2))
    alpha = np.where(distance < 1e-12, 0.0, np.clip(spread / np.where(distance < 1e-12, 1.0, distance) / n_obs, 0.0, 1.0))[:, None, None]
    return (1 - alpha) * base + alpha * target


def cov_ewma(x: np.ndarray, lam: float = LAMBDA) -> np.ndarray:
    if not 0 < lam < 1:
        raise ValueError(f"lam must be in (0, 1), got {lam}")
    w = lam ** np.arange(x.shape[1] - 1, -1, -1.0)
    w /= w.sum()
    c = (x - np.einsum("t,ktn->kn", w, x)[:, None, :]) * np.sqrt(w)[None, :, None]
    return c.transpose(0, 2, 1) @ c


#: Name -> function of a (K, T, N) stack of windows and options. ``register_estimator`` adds to it.
ESTIMATORS: dict[str, Callable[..., np.ndarray]] = {"sample": lambda x, **_: cov_sample(x), "ledoit_wolf": lambda x, **_: cov_ledoit_wolf(x), "ewma": lambda x, lam=LAMBDA, **_: cov_ewma(x, lam)}


def register_estimator(name: str, function: Callable[..., np.ndarray]) -> None:
    """Make a function of a (K, T, N) stack of windows known by ``name`` to configurations and workloads; it gets the options of the
    configuration (``lam``) as keywords and travels to executors with the workload."""
    if not name or "|" in name:
        raise ValueError(f"an estimator's name must not be empty or hold '|': {name!r}")
    ESTIMATORS[name] = function


def simplex_rows(v: np.ndarray) -> np.ndarray:
    """Each row's nearest point of the unit simplex."""
    down = -np.sort(-v, axis=1)
    over = (np.cumsum(down, axis=1) - 1) / np.arange(1, v.shape[1] + 1)
    return np.maximum(v - over.max(axis=1)[:, None], 0.0)


def simplex_rows_bisection(v: np.ndarray, steps: int = 30) -> np.ndarray:
    """The same point by halving the interval of the threshold: a fixed amount of work without a sort."""
    low, high = v.min(axis=1) - 1.0, v.max(axis=1)
    for _ in range(steps):
        middle = (low + high) / 2
        above = np.maximum(v - middle[:, None], 0.0).sum(axis=1) > 1
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return np.maximum(v - ((low + high) / 2)[:, None], 0.0)


def simplex_rows_from(v: np.ndarray, threshold: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The same point and its threshold, by Newton's steps on the threshold from a guess: the sum over what it leaves is convex
    and piecewise linear, so after one step the threshold only grows, and it ends when what is left doesn't change."""
    threshold = np.minimum(threshold, v.max(axis=1) - 1 / v.shape[1])  # something is always left
    for _ in range(most):
        left = v > threshold[:, None]
        again = ((v * left).sum(axis=1) - 1) / left.sum(axis=1)
        if np.array_equal(again, threshold):
            break
        threshold = again
    return np.maximum(v - threshold[:, None], 0.0), threshold


def top_eigenvalue(cov: np.ndarray, method: str = "exact", steps: int = 50) -> np.ndarray:
    if method == "exact":
        return np.linalg.eigvalsh(cov)[:, -1]
    if method != "power":
        raise ValueError(f"unknown method {method!r}; exact or power")
    v = np.full(cov.shape[:2], 1 / np.sqrt(cov.shape[1]))
    for _ in range(steps):
        u = np.einsum("kij,kj->ki", cov, v)
        v = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    return np.einsum("ki,kij,kj->k", v, cov, v)


def min_variance(cov: np.ndarray, long_only: bool = True, steps: int = MIN_VARIANCE_STEPS, step: str = "exact") -> np.ndarray:
    """(K, N) weights: projected gradient with a fixed number of steps, or the closed form.

    All steps run on one block of problems before the next, so that its matrices stay in the processor's cache.
    """
    c = cov + JITTER * np.eye(cov.shape[1])
    if not long_only:
        x = np.linalg.solve(c, np.ones((*cov.shape[:2], 1)))[..., 0]
        return x / x.sum(axis=1, keepdims=True)
    scaled = c / top_eigenvalue(c, step)[:, None, None]
    out = np.full(cov.shape[:2], 1 / cov.shape[1])
    block = max(1, BLOCK_BYTES // (8 * cov.shape[1] ** 2))
    for k in range(0, len(c), block):
        part, w, threshold = scaled[k : k + block], out[k : k + block], np.full(len(c[k : k + block]), -np.inf)
        for _ in range(steps):
            w, threshold = simplex_rows_from(w - np.matmul(part, w[..., None])[..., 0], threshold)
        out[k : k + block] = w
    return out


def optimum(cov: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """(N,) weights of one problem at the exact long-only optimum, by active sets (Lawson and Hanson): the y >= 0 that is least in
    y' C y / 2 - gain' y, made to sum to one. With gains of 1 that is minimum variance, with excess returns the greatest Sharpe ratio.

    Independent of the iterative kernels, and the reference for them; NaN if no gain is positive.
    """
    c = cov + JITTER * np.eye(len(cov))
    if not (gain > 0).any():
        return np.full(len(gain), np.nan)
    y, free = np.zeros(len(gain)), np.zeros(len(gain), bool)
    scale = np.abs(gain).max()
    while not free.all():
        pull = np.where(free, -np.inf, gain - c @ y)
        if pull.max() <= 1e-12 * scale:
            break
        free[np.argmax(pull)] = True
        while True:
            z = np.zeros_like(y)
            z[free] = np.linalg.solve(c[np.ix_(free, free)], gain[free])
            bad = free & (z <= 0)
            if not bad.any():
                break
            y += (y[bad] / (y[bad] - z[bad])).min() * (z - y)
            free &= y > 1e-15 * np.abs(y).max()
            y[~free] = 0
        y = z
    return y / y.sum()


def max_sharpe(cov: np.ndarray, excess: np.ndarray, long_only: bool = True, steps: int = MAX_SHARPE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(K, N) weights and (K,) feasibility: Frank-Wolfe with a fixed number of steps, or the closed form.

    C w and the return are carried along, so a step costs one column of C. Infeasible rows are NaN.
    """
    c = cov + JITTER * np.eye(cov.shape[1])
    if not long_only:
        y = np.linalg.solve(c, excess[..., None])[..., 0]
        return y / y.sum(axis=1, keepdims=True), np.ones(len(c), bool)
    ok = (excess > 0).any(axis=1)
    rows = np.arange(len(c))
    w = np.full(excess.shape, 1 / excess.shape[1])
    cw = (c @ w[..., None])[..., 0]
    ret = (excess * w).sum(axis=1)
    for k in range(steps):
        var = (w * cw).sum(axis=1)
        best = np.argmax(excess * var[:, None] - ret[:, None] * cw, axis=1)  # the gradient, times vol**3
        gamma = 2.0 / (k + 2.0)
        w *= 1 - gamma
        w[rows, best] += gamma
        cw = (1 - gamma) * cw + gamma * c[rows, :, best]
        ret = (1 - gamma) * ret + gamma * excess[rows, best]
    w[~ok] = np.nan
    return w, ok


def weights_for(
    returns: np.ndarray, estimator: str | Callable[..., np.ndarray], objective: str, lookback: int, every: int, long_only: bool = True, solver_rf: float = 0.0, lam: float = LAMBDA, step: str = "exact"
) -> tuple[np.ndarray, np.ndarray]:
    """(K, N) weights of all rebalances of one return matrix, and their feasibility."""
    x = window_stack(returns, lookback, every)
    cov = (ESTIMATORS[estimator] if isinstance(estimator, str) else estimator)(x, lam=lam)
    if objective == "min_variance":
        return min_variance(cov, long_only, step=step), np.ones(len(cov), bool)
    return max_sharpe(cov, x.mean(axis=1) - solver_rf, long_only)


def held_returns(returns: np.ndarray, weights: np.ndarray, lookback: int, every: int) -> np.ndarray:
    """Daily arithmetic returns from ``lookback`` on, at the weights of the latest rebalance."""
    days = np.arange(lookback, len(returns))
    return ((np.exp(returns[lookback:]) - 1) * weights[(days - lookback) // every]).sum(axis=1)


def metrics(r: np.ndarray, rf_annual: float = 0.0, periods: int = PERIODS) -> dict[str, float]:
    """The five metrics; NaN where undefined."""
    nan = float("nan")
    if len(r) == 0:
        return dict.fromkeys(("annual_return", "annual_vol", "sharpe", "max_drawdown", "cagr"), nan)
    annual_return = float(r.mean() * periods)
    annual_vol = float(r.std(ddof=1) * np.sqrt(periods)) if len(r) > 1 else nan
    wealth = np.cumprod(1 + r)
    peak = np.maximum.accumulate(wealth)
    return {
        "annual_return": annual_return,
        "annual_vol": annual_vol,
        "sharpe": (annual_return - rf_annual) / annual_vol if annual_vol >= 1e-10 else nan,
        "max_drawdown": float(((wealth - peak) / peak).min()) if (peak != 0).all() else nan,
        "cagr": float(wealth[-1] ** (periods / len(r)) - 1) if wealth[-1] > 0 else nan,
    }


def fixed_blocks(rng: np.random.Generator, n_days: int, block: int, n: int | None = None) -> np.ndarray:
    """Row numbers of a fixed-block resample."""
    n = n_days if n is None else n
    if not 1 <= block <= n_days:
        raise ValueError(f"block_size must be in [1, {n_days}], got {block}")
    starts = rng.integers(0, n_days - block + 1, -(-n // block))
    return (starts[:, None] + np.arange(block)).ravel()[:n]


def arithmetic_blocks(replicate: int, n_days: int, block: int, seed: int = 42) -> np.ndarray:
    """Row numbers of a fixed-block resample whose draws are arithmetic in the indices, as ``operators.bootstrap.fixed_index`` has them."""
    if not 1 <= block <= n_days:
        raise ValueError(f"block_size must be in [1, {n_days}], got {block}")
    starts = (replicate * 1103515245 + np.arange(-(-n_days // block), dtype=np.int64) * 12345 + seed) % 2147483648 % (n_days - block + 1)
    return (starts[:, None] + np.arange(block)).ravel()[:n_days]


def stationary_blocks(rng: np.random.Generator, n_days: int, mean_block: float, n: int | None = None) -> np.ndarray:
    """Row numbers of a stationary resample: the restart draws come first, then one start a row, used in turn."""
    n = n_days if n is None else n
    if not 1 <= mean_block <= n_days:
        raise ValueError(f"avg_block_size must be in [1, {n_days}], got {mean_block}")
    new = rng.random(n) < 1 / mean_block
    new[0] = True
    starts = rng.integers(0, n_days, n)
    block = np.cumsum(new) - 1
    first = np.flatnonzero(new)[block]
    return (starts[block] + np.arange(n) - first) % n_days


def sub_seed(seed: int, config_idx: int, bootstrap_idx: int) -> int:
    return seed * 1_000_003 + config_idx * 997 + bootstrap_idx


def eigen_range(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest eigenvalue and condition number of each matrix."""
    values = np.linalg.eigvalsh(cov)
    return values[:, 0], values[:, -1], values[:, -1] / np.maximum(values[:, 0], 1e-20)


def frank_wolfe_trace(cov: np.ndarray, excess: np.ndarray, steps: int = 20) -> list[tuple[int, int, float, float, float]]:
    """(step, best asset, volatility, return, greatest gradient) of the first steps on one problem."""
    c = cov + JITTER * np.eye(len(cov))
    w = np.full(len(c), 1 / len(c))
    out = []
    for k in range(steps):
        cw = c @ w
        vol, ret = float(np.sqrt(w @ cw)), float(excess @ w)
        g = excess / vol - ret / vol**3 * cw
        best = int(np.argmax(g))
        out.append((k, best, vol, ret, float(g[best])))
        w *= 1 - 2 / (k + 2)
        w[best] += 2 / (k + 2)
    return out
