"""Solvers, whole backtests and workloads, sources and sinks as registered queries.

Their DuckDB twins step the same iterations in recursive SQL over lists: projected gradient, Frank-Wolfe, power iteration, and
conjugate gradients for linear systems. The panel is type_week: six assets, so that a matrix is a short list of lists.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.config import Config, check_workload, config_frame, grid
from ..operators import metrics as mt
from ..operators import panel as pn
from ..operators import portfolio as pf
from ..operators import rolling as ro
from ..session import shared_folder
from ..sources import panels
from . import backtest as bt
from . import scaling
from .catalogue import _CLEAN, _RETURNS, BLOCK, BOOTS, _config_series, _fixed, _metrics, _panel_sql, _query, _r, prices, returns, rounded
from .catalogue import ORACLES as _ORACLES

PANEL, LOOKBACK, EVERY = "type_week", 63, 21

# --- SQL -----------------------------------------------------------------------------------------------------


def _with(select: str, *ctes: str) -> str:
    return "with recursive " + ",\n".join([_panel_sql(PANEL), _CLEAN, _RETURNS.replace("rx as (", "rx as materialized ("), *ctes]) + "\n" + select


#: The panel itself as replicate 0, or its arithmetic resamples: g, t, asset_idx, r.
_SELF = "src as materialized (select 0 as g, t, asset_idx, r from rx)"
_RESAMPLED = _fixed(BLOCK, "ix", BOOTS) + ", src as materialized (select boot as g, pos as t, asset_idx, r from ix join rx on rx.t = src_t)"


def _window_sql(tag: str, lookback: int = LOOKBACK, every: int = EVERY) -> str:
    """{tag}_win: key (replicate * 10000 + rebalance), t, asset_idx, r, age."""
    return f"""
    {tag}_cal as (select g, t as t_from, (t - {lookback}) // {every} as rb from (select distinct g, t from src) where t >= {lookback} and (t - {lookback}) % {every} = 0),
    {tag}_win as materialized (select c.g * 10000 + c.rb as key, r.t, r.asset_idx, r.r, c.t_from - 1 - r.t as age from {tag}_cal c join src r on r.g = c.g and r.t >= c.t_from - {lookback} and r.t < c.t_from)"""


def _cov_sql(tag: str, estimator: str, lam: float = 0.94) -> str:
    """{tag}_c: key, n, c (the matrix with jitter, as lists), mu."""
    pairs = "select a.key, a.asset_idx as i, b.asset_idx as j, {0} as cov from {1} a join {1} b on a.key = b.key and a.t = b.t group by 1, 2, 3"
    if estimator in ("sample", "diagonal"):
        cov = f"{tag}_cov as (" + pairs.format("covar_samp(a.r, b.r)" if estimator == "sample" else "case when a.asset_idx = b.asset_idx then covar_samp(a.r, b.r) else 0.0 end", f"{tag}_win") + ")"
    elif estimator == "ewma":
        cov = f"""
        {tag}_wm as (select *, pow({lam}, age) as wt from {tag}_win),
        {tag}_ce as (select key, t, asset_idx, wt, r - sum(wt * r) over (partition by key, asset_idx) / sum(wt) over (partition by key, asset_idx) as r from {tag}_wm),
        {tag}_cov as ({pairs.format("sum(a.wt * a.r * b.r) / sum(a.wt)", f"{tag}_ce")})"""
    else:
        cov = f"""
        {tag}_ce as (select key, t, asset_idx, r - avg(r) over (partition by key, asset_idx) as r from {tag}_win),
        {tag}_b as (select a.key, a.asset_idx as i, b.asset_idx as j, avg(a.r * b.r) as s, avg(a.r * a.r * b.r * b.r) as q, count(*) as n from {tag}_ce a join {tag}_ce b on a.key = b.key and a.t = b.t group by 1, 2, 3),
        {tag}_tb as (select *, case when i = j then avg(s) filter (where i = j) over (partition by key) else 0.0 end as target from {tag}_b),
        {tag}_al as (select key, greatest(0.0, least(1.0, sum(q - s * s) / sum(pow(s - target, 2)) / max(n))) as alpha from {tag}_tb group by key),
        {tag}_cov as (select b.key, i, j, (1 - alpha) * s + alpha * target as cov from {tag}_tb b join {tag}_al a on a.key = b.key)"""
    return f"""{cov},
    {tag}_rows as (select key, i, list(cov + case when i = j then 1e-10 else 0.0 end order by j) as row from {tag}_cov group by 1, 2),
    {tag}_mu as (select key, list(m order by asset_idx) as mu from (select key, asset_idx, avg(r) as m from {tag}_win group by 1, 2) group by key),
    {tag}_c as materialized (select x.key, count(*) as n, list(row order by i) as c, any_value(mu) as mu from {tag}_rows x join {tag}_mu m on m.key = x.key group by 1)"""


_PRODUCT = "list_transform(c, lambda x: list_dot_product(x, {0}))"


def _power_sql(tag: str, steps: int, source: str = "_c") -> str:
    """{tag}_top: key, top (the Rayleigh quotient after ``steps`` of power iteration)."""
    return f"""
    {tag}_pw as (select key, 0 as k, list_transform(range(n), lambda z: 1 / sqrt(n)) as v from {tag}{source} union all
        select key, k + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) from (select p.key, k, {_PRODUCT.format('v')} as u from {tag}_pw p join {tag}{source} m on m.key = p.key where k < {steps})),
    {tag}_top as materialized (select p.key, list_dot_product(v, {_PRODUCT.format('v')}) as top from {tag}_pw p join {tag}{source} m on m.key = p.key where k = {steps})"""


def _min_variance_sql(tag: str, steps: int = kernels.MIN_VARIANCE_STEPS, power: int = 1000) -> str:
    """{tag}_w: key, w. A simplex projection's threshold is the greatest of the means that sorted values suggest."""
    return f"""{_power_sql(tag, power)},
    {tag}_pg as (select key, 0 as k, list_transform(range(n), lambda z: 1.0 / n) as w from {tag}_c union all
        select key, k + 1, list_transform(v, lambda x: greatest(x - list_max(list_transform(range(1, len(v) + 1), lambda i: (list_sum(s[1:i]) - 1) / i)), 0.0)) from (
            select *, list_reverse_sort(v) as s from (
                select p.key, k, list_transform(range(1, n + 1), lambda i: w[i] - list_dot_product(c[i], w) / top) as v from {tag}_pg p join {tag}_c m on m.key = p.key join {tag}_top t on t.key = p.key where k < {steps}))),
    {tag}_w as materialized (select key, w from {tag}_pg where k = {steps})"""


def _frank_wolfe_sql(tag: str, steps: int = kernels.MAX_SHARPE_STEPS) -> str:
    """{tag}_w: key, w (null without a positive mean)."""
    return f"""
    {tag}_fw as (select key, 0 as k, list_transform(range(n), lambda z: 1.0 / n) as w from {tag}_c union all
        select key, k + 1, list_transform(range(1, n + 1), lambda i: w[i] * (1 - 2.0 / (k + 2)) + case when i = list_position(gr, list_max(gr)) then 2.0 / (k + 2) else 0.0 end) from (
            select *, list_transform(range(1, n + 1), lambda i: mu[i] * list_dot_product(w, cw) - list_dot_product(mu, w) * cw[i]) as gr from (
                select p.key, k, w, n, mu, {_PRODUCT.format('w')} as cw from {tag}_fw p join {tag}_c m on m.key = p.key where k < {steps} and list_max(mu) > 0))),
    {tag}_w as materialized (select m.key, w from {tag}_c m left join (select key, w from {tag}_fw where k = {steps}) f on f.key = m.key)"""


def _linear_sql(tag: str, right: str, steps: int = 24) -> str:
    """{tag}_w: key, w: the solution of C x = right by conjugate gradients, made to sum to one."""
    return f"""
    {tag}_cg as (select key, 0 as k, list_transform(range(n), lambda z: 0::double) as x, {right} as r, {right} as p from {tag}_c union all
        select key, k + 1, x2, r2, list_transform(range(1, n + 1), lambda i: r2[i] + case when rr > 1e-300 then list_dot_product(r2, r2) / rr else 0.0 end * p[i]) from (
            select *, list_transform(range(1, n + 1), lambda i: x[i] + al * p[i]) as x2, list_transform(range(1, n + 1), lambda i: r[i] - al * cp[i]) as r2 from (
                select *, list_dot_product(r, r) as rr, case when list_dot_product(p, cp) > 1e-300 then list_dot_product(r, r) / list_dot_product(p, cp) else 0.0 end as al from (
                    select g.key, k, x, r, p, n, {_PRODUCT.format('p')} as cp from {tag}_cg g join {tag}_c m on m.key = g.key where k < {steps})))),
    {tag}_w as materialized (select key, list_transform(x, lambda z: z / list_sum(x)) as w from {tag}_cg where k = {steps})"""


def _gain_sql(tag: str, gain: str, steps: int = 4000) -> str:
    """{tag}_w: key, w: the y >= 0 that is least in y' C y / 2 - gain' y, by projected gradient, made to sum to one; null without a positive gain."""
    return f"""{_power_sql(tag, 1000)},
    {tag}_g as materialized (select key, {gain} as gain from {tag}_c),
    {tag}_nn as (select key, 0 as k, list_transform(gain, lambda z: 0::double) as y from {tag}_g union all
        select p.key, k + 1, list_transform(range(1, n + 1), lambda i: greatest(0.0, y[i] - (list_dot_product(c[i], y) - gain[i]) / top)) from {tag}_nn p join {tag}_c m on m.key = p.key join {tag}_g g on g.key = p.key join {tag}_top t on t.key = p.key where k < {steps}),
    {tag}_w as materialized (select key, case when list_sum(y) > 0 then list_transform(y, lambda z: z / list_sum(y)) end as w from {tag}_nn where k = {steps})"""


def _held_sql(tag: str, lookback: int = LOOKBACK, every: int = EVERY) -> str:
    """{tag}_held: g, t, port_ret (null at infeasible weights)."""
    return f"{tag}_held as (select s.g, s.t, sum(w[s.asset_idx + 1] * (exp(s.r) - 1)) as port_ret from src s join {tag}_w w on w.key = s.g * 10000 + (s.t - {lookback}) // {every} where s.t >= {lookback} group by 1, 2)"


_SOLVERS = {"min_variance": _min_variance_sql, "max_sharpe": _frank_wolfe_sql}
_ONES = "list_transform(range(n), lambda z: 1::double)"


def _whole_sql(tag: str, estimator: str, objective: str, lam: float = 0.94, **options) -> str:
    return ",\n".join([_window_sql(tag), _cov_sql(tag, estimator, lam), _SOLVERS[objective](tag, **options), _held_sql(tag)])


def _daily_sql(*wholes: str) -> str:
    return " union all ".join(f"select {i} as config_idx, t, {_r('port_ret', 'port_ret')} from {tag}_held" for i, tag in enumerate(wholes))


def _long_sql(*tags: str) -> str:
    one = "select {0} as config_idx, cast(key as int) as rb_seq, cast({1} + key * {2} as int) as t_from, case when w is null then 'infeasible' else 'ok' end as status, cast(i as int) as asset_idx, round(w[i + 1], 8) + 0.0 as w from {3}_w join {3}_c using (key), unnest(range(0, n)) as u(i) where w is not null"
    return " union all ".join(one.format(k, LOOKBACK, EVERY, tag) for k, tag in enumerate(tags))


def _raw_sql(select: str, *configs: tuple[str, str, str]) -> str:
    """``select`` from raw (config_idx, boot, the metrics, status) of (tag, estimator, objective) on the arithmetic resamples."""
    parts, rows = [_RESAMPLED], []
    for k, (tag, estimator, objective) in enumerate(configs):
        parts += [_whole_sql(tag, estimator, objective), f"{tag}_bad as (select distinct key // 10000 as g from {tag}_w where w is null), {tag}_ok as (select g as boot, t, port_ret from {tag}_held where g not in (select g from {tag}_bad))", _metrics(f"{tag}_ok", "boot", f"{tag}_m")]
        label = f"{estimator}|{objective}|lb={LOOKBACK}|rb={EVERY}"
        names = f"{k} as config_idx, '{estimator}' as estimator, '{objective}' as objective, {LOOKBACK} as lookback, {EVERY} as rebalance_every, '{label}' as label"
        rows.append(f"select {names}, cast(b.boot as int) as bootstrap_idx, annual_return, annual_vol, sharpe, max_drawdown, ln(1 + cagr) as log_growth, case when m.boot is null then 'infeasible' else 'ok' end as status from (select unnest(range(0, {BOOTS})) as boot) b left join {tag}_m m on m.boot = b.boot")
    return _with(select, *parts, "raw as (" + " union all ".join(rows) + ")")


# --- backtests -----------------------------------------------------------------------------------------------


def _panel(spark, sf_dir) -> DataFrame:
    return returns(spark, sf_dir, PANEL)


def _daily(spark, sf_dir, configs: list[Config]) -> DataFrame:
    return rounded(bt.backtest(spark, _panel(spark, sf_dir), configs)[1])


def _long(weights: DataFrame) -> DataFrame:
    return rounded(weights.select("config_idx", "rb_seq", "t_from", "status", F.posexplode("w").alias("asset_idx", "w")))


def _config(estimator: str, objective: str, **options) -> Config:
    return Config(estimator, objective, LOOKBACK, EVERY, **options)


@_query("backtest_min_variance", _with(_daily_sql("a", "b", "c"), _SELF, _whole_sql("a", "sample", "min_variance"), _whole_sql("b", "ledoit_wolf", "min_variance"), _whole_sql("c", "ewma", "min_variance")))
def backtest_min_variance(spark, sf_dir):
    return _daily(spark, sf_dir, [_config(e, "min_variance") for e in ("sample", "ledoit_wolf", "ewma")])


@_query("backtest_max_sharpe", _with(_daily_sql("a"), _SELF, _whole_sql("a", "ledoit_wolf", "max_sharpe")))
def backtest_max_sharpe(spark, sf_dir):
    return _daily(spark, sf_dir, [_config("ledoit_wolf", "max_sharpe")])


@_query("backtest_weights", _with(_long_sql("a", "b"), _SELF, _whole_sql("a", "sample", "min_variance"), _whole_sql("b", "sample", "max_sharpe")))
def backtest_weights(spark, sf_dir):
    return _long(bt.backtest(spark, _panel(spark, sf_dir), [_config("sample", "min_variance"), _config("sample", "max_sharpe")])[0])


@_query(
    "backtest_long_short",
    _with(_daily_sql("a", "b"), _SELF, _window_sql("a"), _cov_sql("a", "ledoit_wolf"), _linear_sql("a", _ONES), _held_sql("a"), _window_sql("b"), _cov_sql("b", "ledoit_wolf"), _linear_sql("b", "mu"), _held_sql("b")),
)
def backtest_long_short(spark, sf_dir):
    return _daily(spark, sf_dir, [_config("ledoit_wolf", o, long_only=False) for o in ("min_variance", "max_sharpe")])


@_query("backtest_power_step", _with(_daily_sql("a"), _SELF, _whole_sql("a", "sample", "min_variance", power=50)))
def backtest_power_step(spark, sf_dir):
    """The step size from fifty rounds of power iteration."""
    return _daily(spark, sf_dir, [_config("sample", "min_variance", step="power")])


@_query("backtest_estimator_option", _with(_daily_sql("a"), _SELF, _whole_sql("a", "ewma", "min_variance", 0.97)))
def backtest_estimator_option(spark, sf_dir):
    return _daily(spark, sf_dir, [_config("ewma", "min_variance", lam=0.97)])


def diagonal_covariance(x: np.ndarray, **_: object) -> np.ndarray:
    """A user's estimator: variances alone."""
    return kernels.cov_sample(x) * np.eye(x.shape[2])


@_query("backtest_user_estimator", _with(_daily_sql("a"), _SELF, _whole_sql("a", "diagonal", "min_variance")))
def backtest_user_estimator(spark, sf_dir):
    kernels.register_estimator("diagonal", diagonal_covariance)
    return _daily(spark, sf_dir, [_config("diagonal", "min_variance")])


_BOOT = (("a", "sample", "min_variance"), ("b", "ledoit_wolf", "min_variance"), ("c", "ledoit_wolf", "max_sharpe"))
_FOUR = mt.METRICS[:-1]
_RAW_COLUMNS = "config_idx, bootstrap_idx, estimator, objective, lookback, rebalance_every, label, status, " + ", ".join(_r(m, m) for m in (*_FOUR, "log_growth"))


def _raw(raw: DataFrame) -> DataFrame:
    return rounded(raw.withColumn("log_growth", F.log(1 + F.col("cagr"))).select("config_idx", "bootstrap_idx", "estimator", "objective", "lookback", "rebalance_every", "label", "status", *_FOUR, "log_growth"))


@_query("bootstrap_backtest", _raw_sql(f"select {_RAW_COLUMNS} from raw", *_BOOT))
def bootstrap_backtest(spark, sf_dir):
    configs = [_config(e, o) for _, e, o in _BOOT]
    return _raw(bt.bootstrap(spark, _panel(spark, sf_dir), configs, BOOTS, BLOCK, mode="arithmetic").raw_metrics)


@_query("bootstrap_resumed", _ORACLES["bootstrap_backtest"])
def bootstrap_resumed(spark, sf_dir):
    """The same from a store: the second call reads what the first has solved."""
    configs, store = [_config(e, o) for _, e, o in _BOOT], f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    for _ in range(2):
        found = bt.bootstrap(spark, _panel(spark, sf_dir), configs, BOOTS, BLOCK, mode="arithmetic", store=store)
    return _raw(found.raw_metrics)


_SUMMED = ", ".join(f"{_r(f'avg({m})', f'{m}_mean')}, {_r(f'quantile_cont({m}, 0.05)', f'{m}_p05')}, {_r(f'quantile_cont({m}, 0.95)', f'{m}_p95')}" for m in _FOUR)


@_query("bootstrap_backtest_summary", _raw_sql(f"select config_idx, estimator, objective, lookback, rebalance_every, label, {_SUMMED} from raw group by all", *_BOOT))
def bootstrap_backtest_summary(spark, sf_dir):
    configs = [_config(e, o) for _, e, o in _BOOT]
    found = bt.bootstrap(spark, _panel(spark, sf_dir), configs, BOOTS, BLOCK, mode="arithmetic").metrics_per_config
    return rounded(found.drop(*[c for c in found.columns if c.startswith("cagr")]))


# --- solvers on distributed problems -------------------------------------------------------------------------


def _problems(spark, sf_dir, gain: str = "mu") -> DataFrame:
    """key, n, cov, mu of every rebalance, built and kept distributed."""
    window = ro.windows(_panel(spark, sf_dir), LOOKBACK, EVERY)
    cov = pf.mirrored(ro.cov_sample(window)).groupBy("rb_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))), lambda x: x["cov"]).alias("cov"))
    mu = ro.means(window).groupBy("rb_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset_idx", "mu"))), lambda x: x["mu"]).alias("mu"))
    one = F.transform("mu", lambda _: F.lit(1.0)) if gain == "one" else F.col("mu")
    return cov.join(mu, "rb_seq").select(F.col("rb_seq").alias("key"), F.size("mu").alias("n"), "cov", one.alias("mu"))


def _solved(found: DataFrame, digits: int = 8) -> DataFrame:
    return rounded(found.select("key", "status", F.posexplode("w").alias("asset_idx", "w")), digits)


def _solved_sql(tag: str, digits: int = 8) -> str:
    return f"select cast(key as int) as key, 'ok' as status, cast(i as int) as asset_idx, round(w[i + 1], {digits}) + 0.0 as w from {tag}_w join {tag}_c using (key), unnest(range(0, n)) as u(i) where w is not null"


@_query("batch_solve", _with(_solved_sql("a"), _SELF, _window_sql("a"), _cov_sql("a", "sample"), _min_variance_sql("a")))
def batch_solve(spark, sf_dir):
    return _solved(bt.solve_stack(_problems(spark, sf_dir)))


@_query("batch_solve_max_sharpe", _with(_solved_sql("a"), _SELF, _window_sql("a"), _cov_sql("a", "sample"), _frank_wolfe_sql("a")))
def batch_solve_max_sharpe(spark, sf_dir):
    return _solved(bt.solve_stack(_problems(spark, sf_dir), "max_sharpe"))


@_query("optimum_min_variance", _with(_solved_sql("a", 6), _SELF, _window_sql("a"), _cov_sql("a", "sample"), _gain_sql("a", _ONES)))
def optimum_min_variance(spark, sf_dir):
    """The exact optimum by active sets, against a long projected gradient."""
    return _solved(bt.solve_stack(_problems(spark, sf_dir, "one"), "optimum"), 6)


@_query("optimum_max_sharpe", _with(_solved_sql("a", 6), _SELF, _window_sql("a"), _cov_sql("a", "sample"), _gain_sql("a", "mu")))
def optimum_max_sharpe(spark, sf_dir):
    return _solved(bt.solve_stack(_problems(spark, sf_dir), "optimum"), 6)


_PROJECTED = """
    m as (select rb_seq, asset_idx, avg(r) as mu from (select c.t // 21 - 3 as rb_seq, r.asset_idx, r.r from (select distinct t from rx where t >= 63 and (t - 63) % 21 = 0) c join rx r on r.t >= c.t - 63 and r.t < c.t) group by 1, 2),
    l as (select rb_seq, list(mu order by asset_idx) as v, list_reverse_sort(list(mu)) as s from m group by 1)"""


@_query("simplex_bisection", _with(f"select cast(rb_seq as int) as key, cast(i as int) as asset_idx, {_r('greatest(v[i + 1] - list_max(list_transform(range(1, len(v) + 1), lambda z: (list_sum(s[1:z]) - 1) / z)), 0.0)', 'w')} from l, unnest(range(0, len(v))) as u(i)", _PROJECTED))
def simplex_bisection(spark, sf_dir):
    """Projection on the simplex by halving, 60 steps, of the windows' means."""
    means = ro.means(ro.windows(_panel(spark, sf_dir), LOOKBACK, EVERY)).groupBy("rb_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset_idx", "mu"))), lambda x: x["mu"]).alias("v"))

    def project(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"key": batch["rb_seq"], "w": list(kernels.simplex_rows_bisection(np.stack(batch["v"].to_numpy()), 60))})

    return rounded(means.mapInPandas(project, "key int, w array<double>").select("key", F.posexplode("w").alias("asset_idx", "w")))


_TWO = """
    two as (select x.key, max(cov) filter (where i = 0 and j = 0) as a, max(cov) filter (where i = 0 and j = 1) as b, max(cov) filter (where i = 1 and j = 1) as d from a_cov x where i < 2 and j < 2 group by 1),
    e as (select key, (a + d) / 2 as mid, sqrt(pow((a - d) / 2, 2) + b * b) as half from two),
    p_c as materialized (select key, 2 as n, [[a, b], [b, d]] as c from two)"""


@_query("eigen_diagnostics", _with(f"select cast(e.key as int) as key, {_r('mid - half', 'min_eig')}, {_r('mid + half', 'max_eig')}, {_r('top', 'power_eig')}, {_r('(mid + half) / (mid - half)', 'cond')} from e join p_top p on p.key = e.key", _SELF, _window_sql("a"), _cov_sql("a", "sample"), _TWO, _power_sql("p", 50)))
def eigen_diagnostics(spark, sf_dir):
    """Of the first two assets, where eigenvalues have a closed form."""
    return rounded(bt.eigen_diagnostics(spark, _panel(spark, sf_dir).where("asset_idx < 2"), "sample", LOOKBACK, EVERY))


_TRACE = """
    tr as (select key, 0 as k, list_transform(range(n), lambda z: 1.0 / n) as w from a_c union all
        select key, k + 1, list_transform(range(1, n + 1), lambda i: w[i] * (1 - 2.0 / (k + 2)) + case when i = list_position(gr, list_max(gr)) then 2.0 / (k + 2) else 0.0 end) from (
            select *, list_transform(range(1, n + 1), lambda i: mu[i] * list_dot_product(w, cw) - list_dot_product(mu, w) * cw[i]) as gr from (
                select p.key, k, w, n, mu, list_transform(c, lambda x: list_dot_product(x, w)) as cw from tr p join a_c m on m.key = p.key where k < 19))),
    seen as (select key, k, sqrt(list_dot_product(w, cw)) as vol, list_dot_product(mu, w) as ret, cw, mu from (select p.key, k, w, mu, list_transform(c, lambda x: list_dot_product(x, w)) as cw from tr p join a_c m on m.key = p.key)),
    gr as (select *, list_transform(range(1, len(mu) + 1), lambda i: mu[i] / vol - ret / pow(vol, 3) * cw[i]) as g from seen)"""


@_query("frank_wolfe_trace", _with(f"select cast(key as int) as rb_seq, cast(k as int) as k, cast(list_position(g, list_max(g)) - 1 as int) as best, {_r('vol', 'vol')}, {_r('ret', 'ret')}, {_r('list_max(g)', 'grad_max')} from gr", _SELF, _window_sql("a"), _cov_sql("a", "sample"), _TRACE))
def frank_wolfe_trace(spark, sf_dir):
    return rounded(bt.frank_wolfe_trace(spark, _panel(spark, sf_dir), "sample", LOOKBACK, EVERY))


@_query("online_backtest", _with(f"select t, {_r('port_ret', 'port_ret')} from a_held", _SELF, _whole_sql("a", "sample", "min_variance")))
def online_backtest(spark, sf_dir):
    """Extension: the backtest of days that arrive as a stream, in three micro-batches."""
    from ..streaming.online import online_backtest as stream

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    days = _panel(spark, sf_dir).groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset_idx", "r"))), lambda x: x["r"]).alias("r"))
    days = days.select(F.lit("s").alias("stream"), F.col("t").cast("long").alias("t"), "r")
    for k in range(3):
        days.where((F.col("t") >= 120 * k) & (F.lit(k == 2) | (F.col("t") < 120 * (k + 1)))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema("stream string, t long, r array<double>").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = stream(source, LOOKBACK, EVERY).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return rounded(spark.read.schema("stream string, t long, port_ret double").parquet(f"{folder}/out").select(F.col("t").cast("int").alias("t"), "port_ret"))


# --- sources, sinks, checks ----------------------------------------------------------------------------------


@_query("stored_panel", _ORACLES["panel_clean_prices"])
def stored_panel(spark, sf_dir):
    """A cleaned panel through the store that is keyed by all its parameters; the second call reads it."""
    folder = f"{shared_folder(spark)}/panels-{uuid.uuid4().hex}"
    for _ in range(2):
        panel = panels.stored(spark, folder, lambda: pn.clean_prices(prices(spark, sf_dir, "type_day")), panel="type_day", source=sf_dir)
    return rounded(panel.withColumn("price", F.col("price") + 0.0000012345), 4)


@_query("wide_panel", "with " + _panel_sql("type_week") + f" select dt, asset, {_r('price', 'price')} from px")
def wide_panel(spark, sf_dir):
    """To one column an asset and back; fields are picked by name."""
    px = prices(spark, sf_dir, "type_week")
    assets = [r.asset for r in px.select("asset").distinct().orderBy("asset").collect()]  # columns of the wide form: a bounded list
    return rounded(panels.long_panel(panels.wide_panel(px, assets)).where("price is not null"))


@_query("report_as_csv", _ORACLES["strategy_report"])
def report_as_csv(spark, sf_dir):
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report = mt.strategy_report(_config_series(spark, sf_dir))
    panels.write_report(report, path)
    return rounded(panels.read_report(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema)))


@_query("configs_as_json", _ORACLES["config_grid"])
def configs_as_json(spark, sf_dir):
    path = f"{shared_folder(spark)}/configs-{uuid.uuid4().hex}"
    configs = config_frame(spark, grid())
    panels.write_json(configs, path)
    return panels.read_json(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in configs.schema))


_U = "(({0}::bigint * 1103515245 + 12345 * {1} + 42) % 2147483648 + 0.5) / 2147483648.0"


@_query("synthetic_returns", f"select cast(id // 10 as int) as t, cast(id % 10 as int) as asset_idx, {_r(f'0.01 * sqrt(-2 * ln({_U.format("id", 1)})) * cos(2 * pi() * {_U.format("id", 7919)})', 'r')} from (select unnest(range(0, 2520)) as id)")
def synthetic_returns(spark, sf_dir):
    return rounded(panels.arithmetic_returns(spark, 252, 10))


_BAD = [
    ("unknown estimator", lambda: Config("x")),
    ("unknown objective", lambda: Config(objective="x")),
    ("unknown step", lambda: Config(step="x")),
    ("lookback below two", lambda: Config(lookback=1)),
    ("no rebalancing", lambda: Config(rebalance_every=0)),
    ("decay of one", lambda: Config(lam=1.0)),
    ("one day", lambda: check_workload(1, [], 1, 1)),
    ("lookback as long as the panel", lambda: check_workload(50, [Config(lookback=50)], 1, 5)),
    ("no replicates", lambda: check_workload(50, [], 0, 5)),
    ("block beyond the panel", lambda: check_workload(50, [], 1, 51)),
    ("block of nothing", lambda: check_workload(50, [], 1, 0)),
    ("right", lambda: check_workload(50, [Config(lookback=49)], 1, 50)),
]


@_query("parameter_checks", "select * from (values " + ", ".join(f"('{name}', {str(name != 'right').lower()})" for name, _ in _BAD) + ") v(parameters, refused)")
def parameter_checks(spark, sf_dir):
    def refused(make) -> bool:
        try:
            make()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(name, refused(make)) for name, make in _BAD], "parameters string, refused boolean")


_TIMES = [(1, 97.341), (2, 63.138), (4, 49.740), (8, 35.685)]  # fixed values: published seconds by number of workers


@_query("scaling_table", "with t(workers, seconds) as (values " + ", ".join(f"({n}, {s})" for n, s in _TIMES) + f") select cast(workers as int) as workers, {_r('cast(seconds as double)', 'seconds')}, {_r('97.341 / seconds', 'speedup')}, {_r('97.341 / seconds / workers', 'efficiency')}, {_r('seconds / 360 * 54000', 'projected')} from t")
def scaling_table(spark, sf_dir):
    """Speedup and efficiency against one worker, and the time that a workload of 54,000 backtests would take at the rate of 360."""
    times = spark.createDataFrame(_TIMES, "workers int, seconds double")
    return rounded(scaling.projected(scaling.speedups(times), 360, 54_000))
