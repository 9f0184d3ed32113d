"""Batched kernels against one-problem loops, optimality conditions and closed forms."""

from __future__ import annotations

import numpy as np
import pytest

from stridelake.functions import kernels as k


def problems(n=6, count=9, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, 60, n)) * 0.01 + 0.001
    return x, k.cov_sample(x)


def project_one(v):
    u = np.sort(v)[::-1]
    c = np.cumsum(u) - 1
    rho = max(i for i in range(len(v)) if u[i] - c[i] / (i + 1) > 0)
    return np.maximum(v - c[rho] / (rho + 1), 0)


def test_simplex_rows_are_projections():
    v = np.random.default_rng(1).normal(size=(50, 7)) * 3
    got = k.simplex_rows(v)
    assert np.allclose(got, [project_one(x) for x in v], atol=1e-12)
    assert np.allclose(got.sum(1), 1) and (got >= 0).all()


def test_min_variance_equals_single_loops_and_is_optimal():
    _, cov = problems()
    got = k.min_variance(cov)
    for c, w in zip(cov, got):
        c = c + k.JITTER * np.eye(len(c))
        top, x = np.linalg.eigvalsh(c).max(), np.full(len(c), 1 / len(c))
        for _ in range(k.MIN_VARIANCE_STEPS):
            x = project_one(x - (1 / (2 * top)) * (2 * c @ x))
        assert np.allclose(w, x, atol=1e-10)
        g = c @ w
        assert np.ptp(g[w > 1e-6]) < 1e-9 and (g[w <= 1e-6] >= g[w > 1e-6].mean() - 1e-9).all()


def test_max_sharpe_equals_single_loops():
    x, cov = problems(5, 4, 3)
    mu = x.mean(1)
    got, ok = k.max_sharpe(cov, mu, steps=400)
    assert ok.all()
    for c, m, w in zip(cov, mu, got):
        c, one = c + k.JITTER * np.eye(5), np.full(5, 0.2)
        for s in range(400):
            cw = c @ one
            vol, ret = np.sqrt(one @ cw), m @ one
            best = np.argmax(m / vol - ret / vol**3 * cw)
            one = one * (1 - 2 / (s + 2))
            one[best] += 2 / (s + 2)
        assert np.allclose(w, one, atol=1e-9)


def test_infeasible_and_closed_forms():
    _, cov = problems(2, 3)
    w, ok = k.max_sharpe(cov, np.array([[-1.0, -2], [0.1, -1], [0.2, 0.1]]), steps=10)
    assert list(ok) == [False, True, True] and np.isnan(w[0]).all()
    long_short = k.min_variance(cov, long_only=False)
    c = cov + k.JITTER * np.eye(2)
    want = (c[:, 1, 1] - c[:, 0, 1]) / (c[:, 0, 0] + c[:, 1, 1] - 2 * c[:, 0, 1])
    assert np.allclose(long_short[:, 0], want)


def test_estimators():
    x, cov = problems()
    assert np.allclose(cov[0], np.cov(x[0], rowvar=False))
    shrunk = k.cov_ledoit_wolf(x)[0]
    base = np.cov(x[0], rowvar=False, ddof=0)
    assert np.isclose(np.trace(shrunk), np.trace(base)) and np.linalg.eigvalsh(shrunk).min() > 0
    w = 0.94 ** np.arange(59, -1, -1)
    assert np.allclose(k.cov_ewma(x)[0], np.cov(x[0], rowvar=False, aweights=w, ddof=0))
    with pytest.raises(ValueError):
        k.cov_ewma(x, 1.0)


def test_metrics_cases():
    flat = k.metrics(np.full(252, 0.001))
    assert np.isclose(flat["annual_return"], 0.252) and np.isnan(flat["sharpe"]) and flat["max_drawdown"] == 0 and np.isclose(flat["cagr"], 1.001**252 - 1)
    assert np.isclose(k.metrics(np.array([0.5, -0.5]))["max_drawdown"], -0.5)
    assert k.metrics(np.array([-0.5]))["max_drawdown"] == 0  # the first peak is the wealth after the first day
    assert np.isnan(k.metrics(np.array([-1.0]))["cagr"]) and np.isnan(k.metrics(np.array([0.1]))["annual_vol"])
    assert all(np.isnan(v) for v in k.metrics(np.zeros(0)).values())


def test_resamples():
    rng = lambda: np.random.default_rng(5)
    fixed = k.fixed_blocks(rng(), 50, 8)
    assert len(fixed) == 50 and (np.diff(fixed).reshape(-1)[:7] == 1).all() and fixed.max() < 50
    assert (k.fixed_blocks(rng(), 50, 8) == fixed).all()
    assert len(np.unique(k.fixed_blocks(rng(), 50, 50))) == 50
    moved = k.stationary_blocks(rng(), 50, 10.0, 500)
    step = (np.diff(moved) % 50) != 1
    assert 25 <= step.sum() <= 80
    for bad in (0, 51):
        with pytest.raises(ValueError):
            k.fixed_blocks(rng(), 50, bad)
        with pytest.raises(ValueError):
            k.stationary_blocks(rng(), 50, bad)


def test_held_weights_follow_the_latest_rebalance():
    r = np.log1p(np.random.default_rng(2).normal(size=(30, 3)) * 0.01)
    w, _ = k.weights_for(r, "sample", "min_variance", 10, 7)
    got = k.held_returns(r, w, 10, 7)
    want = [w[(t - 10) // 7] @ (np.exp(r[t]) - 1) for t in range(10, 30)]
    assert np.allclose(got, want) and len(w) == 3


def test_eigenvalues():
    _, cov = problems()
    low, high, cond = k.eigen_range(cov)
    assert (low > 0).all() and np.allclose(cond, high / low)
    assert (k.top_eigenvalue(cov, "power", 200) <= high * (1 + 1e-12)).all()
