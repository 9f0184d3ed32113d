"""Plans and operators on small frames and on the provided tables."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridelake.functions import kernels
from stridelake.functions.config import Config, check_workload, config_frame, grid
from stridelake.operators import bootstrap as bs
from stridelake.operators import metrics as mt
from stridelake.operators import panel as pn
from stridelake.operators import portfolio as pf
from stridelake.operators import rolling as ro
from stridelake.plans import backtest as bt
from stridelake.plans import catalogue, scaling, solvers
from stridelake.sources import panels

DATA = Path("/root/testdata/sf0.001")


def toy_prices(spark, days=40, assets=4, seed=0):
    rng = np.random.default_rng(seed)
    p = 100 * np.exp(np.cumsum(rng.normal(size=(days, assets)) * 0.02, axis=0))
    start = dt.datetime(2020, 1, 1)
    rows = [(start + dt.timedelta(days=i), f"a{j}", float(p[i, j])) for i in range(days) for j in range(assets)]
    return p, spark.createDataFrame(rows, "dt timestamp_ntz, asset string, price double")


def test_cleaning_with_gaps(spark):
    p, df = toy_prices(spark)
    day = F.datediff(F.col("dt").cast("date"), F.lit("2020-01-01"))
    holes = df.where(~((F.col("asset") == "a0") & (day == 0)) & ~((F.col("asset") == "a1") & (day == 7)) & ~((F.col("asset") == "a2") & (day % 3 == 0)))
    assert {r.asset: round(r.missing_frac, 4) for r in pn.missing_fraction(holes).collect()} == {"a0": 0.025, "a1": 0.025, "a2": 0.35, "a3": 0}
    clean = pn.clean_prices(holes).toPandas()
    assert set(clean.asset) == {"a0", "a1", "a3"} and clean.dt.nunique() == 39  # the first date has a gap that nothing fills
    one = clean[(clean.asset == "a1")].sort_values("dt").price.to_numpy()
    assert one[6] == pytest.approx(p[6, 1])  # filled from the day before
    assert pn.clean_prices(holes.limit(0)).count() == 0


def test_backtest_equals_numpy(spark):
    _, df = toy_prices(spark, 60)
    returns = pn.indexed(pn.log_returns(df))
    matrix = bt.return_matrix(returns)
    assert matrix.shape == (59, 4)
    config = Config("ledoit_wolf", "min_variance", 20, 7)
    weights, daily = bt.backtest(spark, returns, [config])
    w, _ = kernels.weights_for(matrix, "ledoit_wolf", "min_variance", 20, 7)
    got = weights.orderBy("rb_seq").toPandas()
    assert np.allclose(np.stack(got.w), w)
    assert np.allclose(daily.orderBy("t").toPandas().port_ret, kernels.held_returns(matrix, w, 20, 7))
    # The relational form of the same estimate, projection check and holding give the same daily returns.
    cov = ro.estimate(ro.windows(returns, 20, 7), "ledoit_wolf")
    long = weights.select("rb_seq", F.posexplode("w").alias("asset_idx", "w"))
    held = pf.hold(returns, long, 20, 7).orderBy("t").toPandas().port_ret
    assert np.allclose(held, kernels.held_returns(matrix, w, 20, 7))
    checks = pf.kkt(long, cov).toPandas()
    assert checks.spread.max() < 1e-7 and checks.inactive_excess.max() < 1e-7
    assert pf.invariants(long).where("abs(sum_w - 1) > 1e-9 or min_w < 0").count() == 0


def test_bootstrap_is_seeded_and_summarised(spark):
    _, df = toy_prices(spark, 60)
    returns = pn.indexed(pn.log_returns(df)).persist()
    configs = [Config("sample", "min_variance", 20, 7), Config("ewma", "max_sharpe", 20, 7)]
    first = bt.bootstrap(spark, returns, configs, 4, 5, seed=3)
    a = first.raw_metrics.orderBy("config_idx", "bootstrap_idx").toPandas()
    matrix = bt.return_matrix(returns)
    idx = kernels.fixed_blocks(np.random.default_rng(kernels.sub_seed(3, 0, 2)), len(matrix), 5)
    sample = matrix[idx]
    w, _ = kernels.weights_for(sample, "sample", "min_variance", 20, 7)
    want = kernels.metrics(kernels.held_returns(sample, w, 20, 7))
    assert a[(a.config_idx == 0) & (a.bootstrap_idx == 2)].sharpe.item() == pytest.approx(want["sharpe"], rel=1e-12)
    pd.testing.assert_frame_equal(a, bt.bootstrap(spark, returns, configs, 4, 5, seed=3).raw_metrics.orderBy("config_idx", "bootstrap_idx").toPandas())
    assert not np.allclose(a.sharpe, bt.bootstrap(spark, returns, configs, 4, 5, seed=4).raw_metrics.orderBy("config_idx", "bootstrap_idx").toPandas().sharpe)
    s = first.metrics_per_config.where("config_idx = 0").toPandas().iloc[0]
    values = a[a.config_idx == 0].sharpe
    assert s.sharpe_mean == pytest.approx(values.mean()) and s.sharpe_p05 == pytest.approx(np.quantile(values, 0.05))


def test_infeasible_is_a_status_or_an_error(spark):
    falling = spark.createDataFrame([(t, i, f"a{i}", -0.01 * (1 + i) + 0.001 * (t % 3)) for t in range(30) for i in range(2)], "t int, asset_idx int, asset string, r double")
    config = [Config("sample", "max_sharpe", 10, 5)]
    assert [r.status for r in bt.bootstrap(spark, falling, config, 2, 3).raw_metrics.collect()] == ["infeasible"] * 2
    with pytest.raises(Exception, match="no asset has a positive"):
        bt.bootstrap(spark, falling, config, 1, 3, strict=True).raw_metrics.collect()


def test_the_optimum_is_reached_by_the_iterations():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(8, 20, 12))
    cov = a.transpose(0, 2, 1) @ a / 20 + 0.05 * np.eye(12)
    mu = rng.normal(size=(8, 12)) * 0.01 + 0.002
    w = kernels.min_variance(cov, steps=4000)
    assert np.allclose(w, [kernels.optimum(c, np.ones(12)) for c in cov], atol=1e-9)
    assert np.allclose(w, kernels.min_variance(cov, steps=4000, step="power"), atol=1e-9)
    best, _ = kernels.max_sharpe(cov, mu, steps=50_000)
    ratio = lambda x, k: mu[k] @ x / np.sqrt(x @ cov[k] @ x)
    assert all(0 <= ratio(kernels.optimum(cov[k], mu[k]), k) - ratio(best[k], k) < 1e-6 for k in range(8))
    assert np.isnan(kernels.optimum(cov[0], -np.ones(12))).all()


def test_projections_agree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        v = np.vstack([rng.normal(size=(50, n)) * 3, np.zeros((1, n)), np.full((1, n), 5.0), -rng.random((20, n)) * 100])
        want = kernels.simplex_rows(v)
        assert np.allclose(want.sum(axis=1), 1) and (want >= 0).all()
        assert np.allclose(want, kernels.simplex_rows_bisection(v, 80), atol=1e-12)
        for start in (-np.inf, 0.0, 1e3):
            assert np.allclose(want, kernels.simplex_rows_from(v, np.full(len(v), start))[0], atol=1e-12)


def test_blocks_of_problems_give_the_same_weights(monkeypatch):
    rng = np.random.default_rng(3)
    cov = kernels.cov_sample(rng.normal(size=(23, 40, 9)))
    want = kernels.min_variance(cov)
    monkeypatch.setattr(kernels, "BLOCK_BYTES", 5 * 8 * 81)
    assert np.allclose(kernels.min_variance(cov), want, atol=1e-14)


def test_registered_estimators_and_options_reach_the_workload(spark):
    _, df = toy_prices(spark, 60)
    returns = pn.indexed(pn.log_returns(df))
    kernels.register_estimator("half", lambda x, lam=0.5, **_: lam * kernels.cov_sample(x) + np.eye(x.shape[2]))
    try:
        config = Config("half", "min_variance", 20, 7, lam=0.25)
        got = bt.backtest(spark, returns, [config])[0].orderBy("rb_seq").toPandas()
        matrix = bt.return_matrix(returns)
        cov = 0.25 * kernels.cov_sample(kernels.window_stack(matrix, 20, 7)) + np.eye(4)
        assert np.allclose(np.stack(got.w), kernels.min_variance(cov))
    finally:
        del kernels.ESTIMATORS["half"]
    for bad in ({"lam": 0.0}, {"step": "x"}, {"estimator": "half"}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        kernels.register_estimator("a|b", kernels.cov_sample)


def test_raw_metrics_are_resumed(spark, tmp_path, monkeypatch):
    _, df = toy_prices(spark, 60)
    returns = pn.indexed(pn.log_returns(df))
    configs = [Config("sample", "min_variance", 20, 7)]
    first = bt.bootstrap(spark, returns, configs, 3, 5, store=str(tmp_path)).raw_metrics.orderBy("bootstrap_idx").toPandas()
    monkeypatch.setattr(bt, "raw_metrics", lambda *a, **k: pytest.fail("solved again"))
    pd.testing.assert_frame_equal(first, bt.bootstrap(spark, returns, configs, 3, 5, store=str(tmp_path)).raw_metrics.orderBy("bootstrap_idx").toPandas())
    with pytest.raises(pytest.fail.Exception):
        bt.bootstrap(spark, returns, configs, 3, 5, seed=9, store=str(tmp_path))


def test_gaps_and_sizes_are_refused(spark, monkeypatch):
    _, df = toy_prices(spark, 10)
    returns = pn.indexed(pn.log_returns(df))
    with pytest.raises(ValueError, match="gaps"):
        bt.return_matrix(returns.where("not (t = 3 and asset_idx = 1)"))
    monkeypatch.setattr(bt, "MOST_MATRIX_BYTES", 100)
    with pytest.raises(ValueError, match="too large"):
        bt.return_matrix(returns)


def test_records_profiles_and_speedups(spark, tmp_path):
    scaling.write_record(scaling.hardware(spark), str(tmp_path / "hw.json"))
    assert '"cores"' in (tmp_path / "hw.json").read_text()
    scaling.warm_up(spark)
    assert "== Physical Plan ==" in scaling.profile(spark.range(5), str(tmp_path / "p.txt")) and (tmp_path / "p.txt").exists()
    times = spark.createDataFrame([(2, 10.0), (4, 6.0)], "workers int, seconds double")
    rows = scaling.projected(scaling.speedups(times), 5, 10).orderBy("workers").collect()
    assert [(round(r.speedup, 3), round(r.efficiency, 3), r.projected) for r in rows] == [(1.0, 1.0, 20.0), (1.667, 0.833, 12.0)]
    assert [v for v, _ in scaling.sweep((1, 2), lambda n: n)] == [1, 2]


def test_validation():
    for bad in ({"estimator": "x"}, {"objective": "x"}, {"lookback": 1}, {"rebalance_every": 0}):
        with pytest.raises(ValueError):
            Config(**bad)
    for args in ((1, [], 1, 1), (50, [Config(lookback=50)], 1, 5), (50, [], 0, 5), (50, [], 1, 51)):
        with pytest.raises(ValueError):
            check_workload(*args)


def test_grid_and_reports(spark, tmp_path):
    assert len(grid()) == 54 and grid()[0].label == "sample|min_variance|lb=63|rb=5"
    raw = config_frame(spark, grid()[:3]).selectExpr("*", "0.1d * config_idx as annual_return", "1d as annual_vol", "if(config_idx = 2, null, 0.5d * config_idx) as sharpe", "-0.1d as max_drawdown", "0.2d as cagr")
    report = mt.strategy_report(raw).toPandas().set_index("rebalance_every")
    assert pd.isna(report.loc[63].sharpe_p05) and report.loc[21].sharpe_mean == 0.5
    assert [r.config_idx for r in mt.top_and_bottom(raw, k=1).collect()] == [1, 0]
    other = raw.withColumn("cagr", F.lit(0.25))
    assert {r.metric: round(r.max_diff, 9) for r in mt.max_abs_diff(raw, other, ["config_idx"]).where("metric = 'cagr'").collect()} == {"cagr": 0.05}
    assert mt.max_abs_diff(raw, other.where("config_idx > 0"), ["config_idx"]).where("metric = 'cagr'").first().max_diff == float("inf")
    panels.write_report(mt.strategy_report(raw), str(tmp_path / "r"))
    assert panels.read_report(spark, str(tmp_path / "r"), "label string, estimator string, objective string, lookback int, rebalance_every int, sharpe_mean double").count() == 3


def test_stored_panels_are_never_stale(spark, tmp_path):
    made = []

    def build(n):
        made.append(n)
        return spark.range(n)

    for n in (3, 3, 4):
        assert panels.stored(spark, str(tmp_path), lambda n=n: build(n), n=n).count() == n
    assert made == [3, 4]


def test_wide_and_long(spark):
    _, df = toy_prices(spark, 5, 2)
    wide = panels.wide_panel(df, ["a0", "a1"])
    assert wide.columns == ["dt", "a0", "a1"] and panels.long_panel(wide).exceptAll(df).count() == 0


def test_index_tables(spark):
    days = spark.createDataFrame([(50,)], "n_days int")
    fixed = bs.fixed_index(days, 3, 8).toPandas()
    assert (fixed.groupby("boot").pos.nunique() == 50).all() and fixed.src_t.between(0, 49).all()
    for _, g in fixed[fixed.pos < 48].assign(blk=lambda x: x.pos // 8).groupby(["boot", "blk"]):
        assert (np.diff(g.sort_values("pos").src_t) == 1).all()
    moved = bs.stationary_index(days, 3, 5.0).toPandas()
    assert moved.src_t.between(0, 49).all() and len(moved) == 150
    with pytest.raises(ValueError):
        bs.fixed_index(days, 1, 51)


def test_plans_have_no_cartesian_blow_up(spark, sf_dir):
    plan = catalogue.cov_sample(spark, sf_dir)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
    scan = catalogue.log_returns(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_comment" not in scan


@pytest.mark.parametrize("name", ["panel_clean_prices", "cov_ledoit_wolf", "hold_weights", "bootstrap_summary", "simplex_projection", "backtest_min_variance", "backtest_long_short", "bootstrap_backtest", "frank_wolfe_trace", "optimum_max_sharpe", "synthetic_returns"])
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(catalogue.ORACLES[name]).df()
    assert solvers.PANEL == "type_week"
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pd.testing.assert_frame_equal(got[columns].sort_values(columns, ignore_index=True), want[columns].sort_values(columns, ignore_index=True), check_dtype=False, atol=1e-9, rtol=0)


def test_online_backtest_equals_batch(spark, tmp_path):
    from stridelake.streaming.online import online_backtest

    rng = np.random.default_rng(0)
    r = rng.normal(size=(30, 3)) * 0.01
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "stream string, t long, r array<double>"
    for k in range(3):
        spark.createDataFrame([("s", t, r[t].tolist()) for t in range(10 * k, 10 * k + 10)], schema).coalesce(1).write.mode("append").parquet(source)
        query = online_backtest(spark.readStream.schema(schema).parquet(source), 12, 5).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination(120)
    got = spark.read.parquet(out).orderBy("t").toPandas()
    w, _ = kernels.weights_for(r, "sample", "min_variance", 12, 5)
    assert np.allclose(got.port_ret, kernels.held_returns(r, w, 12, 5))


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout.split()[-1]) >= len(catalogue.QUERIES), said.stderr


def test_flagship(spark):
    import __spark_entry__

    if DATA.exists():
        assert __spark_entry__.entry(spark).count() == 10
