"""The catalogue: every operator as a registered query over the provided tables, with its DuckDB twin.

Values are rounded to 8 digits on both sides: engines add floating-point numbers in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import Config, config_frame, grid
from ..operators import bootstrap as bs
from ..operators import metrics as mt
from ..operators import panel as pn
from ..operators import portfolio as pf
from ..operators import rolling as ro
from ..session import checkpointed
from ..sources.panels import LINEITEM_PANELS, price_panel
from . import backtest as bt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS, LOOKBACK, EVERY, BOOTS, BLOCK, SEED = 8, 63, 21, 5, 20, 42
#: Configurations whose lookbacks fit the weekly panel.
GRID = {"lookbacks": (21, 63, 126), "rebalances": (5, 21, 63)}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def prices(spark: SparkSession, sf_dir: str, panel: str = "brand_week") -> DataFrame:
    return checkpointed(price_panel(spark, sf_dir, panel))


def returns(spark: SparkSession, sf_dir: str, panel: str = "brand_week") -> DataFrame:
    """The indexed returns of a panel; a panel that the cleaning empties gives none."""
    return checkpointed(pn.indexed(pn.log_returns(pn.clean_prices(prices(spark, sf_dir, panel)))))


# --- SQL fragments -------------------------------------------------------------------------------------------


def _r(expression: str, alias: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0 as {alias}"


def _panel_sql(panel: str) -> str:
    if panel == "event_day":
        return "px as (select cast(date_trunc('day', ts) as timestamp) as dt, event_type as asset, avg(value) as price from events group by 1, 2)"
    column, unit = LINEITEM_PANELS[panel]
    return f"px as (select cast(date_trunc('{unit}', l_shipdate) as timestamp) as dt, {column} as asset, avg(l_extendedprice / l_quantity) as price from lineitem join part on l_partkey = p_partkey group by 1, 2)"


_CLEAN = """
    grid as (select d.dt, a.asset, p.price from (select distinct dt from px) d cross join (select distinct asset from px) a left join px p on p.dt = d.dt and p.asset = a.asset),
    miss as (select asset, avg(case when price is null then 1.0 else 0.0 end) as missing_frac from grid group by asset),
    filled as (select dt, asset, last_value(price ignore nulls) over (partition by asset order by dt rows between unbounded preceding and current row) as price
        from grid where asset in (select asset from miss where missing_frac <= 0.05)),
    clean as (select * from filled where dt in (select dt from filled group by dt having count(price) = count(*)))"""
_RETURNS = """
    ret as (select * from (select dt, asset, ln(price / lag(price) over (partition by asset order by dt)) as r from clean) where r is not null),
    rx as (select r.dt, r.asset, r.r, d.t, a.asset_idx from ret r
        join (select dt, cast(row_number() over (order by dt) - 1 as int) as t from (select distinct dt from ret)) d on d.dt = r.dt
        join (select asset, cast(row_number() over (order by asset) - 1 as int) as asset_idx from (select distinct asset from ret)) a on a.asset = r.asset),
    nd as (select cast(max(t) + 1 as int) as n_days from rx)"""


def _sql(select: str, *ctes: str, panel: str = "brand_week", base: bool = True) -> str:
    parts = ([_panel_sql(panel), _CLEAN, _RETURNS] if base else []) + list(ctes)
    return "with " + ",\n".join(parts) + "\n" + select


def _win(lookback: int = LOOKBACK, every: int = EVERY) -> str:
    return f"""
    cal as (select cast((t - {lookback}) // {every} as int) as rb_seq, t as t_from from (select distinct t from rx) where t >= {lookback} and (t - {lookback}) % {every} = 0),
    win as (select c.rb_seq, c.t_from, r.t, r.asset_idx, r.r, c.t_from - 1 - r.t as age from cal c join rx r on r.t >= c.t_from - {lookback} and r.t < c.t_from)"""


_COV = "cov as (select a.rb_seq, a.asset_idx as i, b.asset_idx as j, covar_samp(a.r, b.r) as cov from win a join win b on a.rb_seq = b.rb_seq and a.t = b.t and a.asset_idx <= b.asset_idx group by 1, 2, 3)"
_FULL = "full_cov as (select rb_seq, i, j, cov from cov union all select rb_seq, j, i, cov from cov where i < j)"
_MU = "mu as (select rb_seq, asset_idx, avg(r) as mu from win group by 1, 2)"
_INVERSE = "w as (select rb_seq, i as asset_idx, (1 / cov) / sum(1 / cov) over (partition by rb_seq) as w from cov where i = j)"
_SIMPLEX = """
    ranked as (select rb_seq, asset_idx, mu, row_number() over o as k, sum(mu) over (partition by rb_seq order by mu desc, asset_idx rows between unbounded preceding and current row) as c
        from mu window o as (partition by rb_seq order by mu desc, asset_idx)),
    tau as (select rb_seq, max_by((c - 1) / k, k) as tau from ranked where mu - (c - 1) / k > 0 group by rb_seq),
    w as (select m.rb_seq, m.asset_idx, greatest(m.mu - t.tau, 0.0) as w from mu m join tau t on t.rb_seq = m.rb_seq)"""
_EQUAL = "ew as (select t, exp(avg(r)) - 1 as port_ret from rx group by t)"


def _fixed(block: int = BLOCK, name: str = "ix", boots: int = BOOTS) -> str:
    return f"""
    {name} as (select boot, pos, src_t from (
        select cast(b.boot as int) as boot, cast(k.blk * {block} + o.off as int) as pos, n_days,
            cast(((cast(b.boot as bigint) * 1103515245 + cast(k.blk as bigint) * 12345 + {SEED}) % 2147483648) % (n_days - {block} + 1) + o.off as int) as src_t
        from nd, (select unnest(range(0, {boots})) as boot) b, (select unnest(range(0, 4000)) as blk) k, (select unnest(range(0, {block})) as off) o
        where k.blk < (n_days + {block} - 1) // {block}) where pos < n_days)"""


def _stationary(name: str = "sx", boots: int = BOOTS) -> str:
    return f"""
    {name}_draw as (select cast(b.boot as int) as boot, cast(p.pos as int) as pos, n_days,
            p.pos = 0 or ((cast(b.boot as bigint) * 1103515245 + cast(p.pos as bigint) * 69069 * 7919 + {SEED}) % 2147483648) / 2147483648.0 < 0.05 as new,
            ((cast(b.boot as bigint) * 22695477 + cast(p.pos as bigint) * 1664525 + 1013904223 + {SEED}) % 2147483648) % n_days as start
        from nd, (select unnest(range(0, {boots})) as boot) b, (select unnest(range(0, 4000)) as pos) p where p.pos < n_days),
    {name} as (select boot, pos, cast((s + pos - p) % n_days as int) as src_t from (
        select boot, pos, n_days, last_value(case when new then pos end ignore nulls) over o as p, last_value(case when new then start end ignore nulls) over o as s
        from {name}_draw window o as (partition by boot order by pos rows between unbounded preceding and current row)))"""


def _boot_equal(index: str, name: str) -> str:
    return f"{name} as (select boot, pos as t, exp(avg(r)) - 1 as port_ret from {index} join rx on rx.t = src_t group by 1, 2)"


def _metrics(source: str, keys: str, name: str) -> str:
    part = f"partition by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    over = f"({part} order by t rows between unbounded preceding and current row)"
    return f"""
    {name}_w as (select *, product(1 + port_ret) over {over} as wealth from {source}),
    {name}_p as (select *, max(wealth) over {over} as peak from {name}_w),
    {name}_a as (select {lead}avg(port_ret) * 252 as annual_return, stddev_samp(port_ret) * sqrt(252.0) as annual_vol, min((wealth - peak) / peak) as max_drawdown,
        product(1 + port_ret) as total, count(*) as n from {name}_p {group}),
    {name} as (select {lead}annual_return, annual_vol, case when annual_vol >= 1e-10 then annual_return / annual_vol end as sharpe, max_drawdown,
        case when total > 0 then pow(total, 252.0 / n) - 1 end as cagr from {name}_a)"""


_FIVE = ", ".join(_r(m, m) for m in mt.METRICS)
_GRID_SQL = """
    e(estimator, a) as (values ('sample', 0), ('ledoit_wolf', 1), ('ewma', 2)), o(objective, b) as (values ('min_variance', 0), ('max_sharpe', 1)),
    l(lookback, c) as (values ({0}, 0), ({1}, 1), ({2}, 2)), q(rebalance_every, d) as (values ({3}, 0), ({4}, 1), ({5}, 2)),
    configs as (select cast(((a * 2 + b) * 3 + c) * 3 + d as int) as config_idx, estimator, objective, cast(lookback as int) as lookback, cast(rebalance_every as int) as rebalance_every,
        true as long_only, cast(0.0 as double) as rf_annual, cast(0.94 as double) as lam, 'exact' as step, estimator || '|' || objective || '|lb=' || lookback || '|rb=' || rebalance_every as label from e, o, l, q)"""
_CONFIGS = _GRID_SQL.format(63, 252, 504, 5, 21, 63)
_SMALL = _GRID_SQL.format(*GRID["lookbacks"], *GRID["rebalances"])


# --- cleaning and returns ------------------------------------------------------------------------------------


@_query("panel_missing_fraction", "with " + _panel_sql("brand_week") + "," + _CLEAN + f" select asset, {_r('missing_frac', 'missing_frac')} from miss")
def panel_missing_fraction(spark, sf_dir):
    return rounded(pn.missing_fraction(prices(spark, sf_dir)))


@_query("panel_clean_prices", "with " + _panel_sql("type_day") + "," + _CLEAN + " select dt, asset, round(price + 0.0000012345, 4) as price from clean")
def panel_clean_prices(spark, sf_dir):
    # Means of few prices often end in a 5 that rounding could send either way; the same small shift on both sides avoids that.
    return rounded(pn.clean_prices(prices(spark, sf_dir, "type_day")).withColumn("price", F.col("price") + 0.0000012345), 4)


@_query("log_returns", _sql(f"select dt, asset, {_r('r', 'r')} from ret"))
def log_returns(spark, sf_dir):
    return rounded(pn.log_returns(pn.clean_prices(prices(spark, sf_dir))))


@_query("arith_returns", _sql(f"select dt, asset, {_r('exp(r) - 1', 'ar')} from ret"))
def arith_returns(spark, sf_dir):
    return rounded(pn.log_returns(pn.clean_prices(prices(spark, sf_dir))).select("dt", "asset", pn.arithmetic(F.col("r")).alias("ar")))


@_query("panel_slice", _sql(f"select t, asset, {_r('r', 'r')} from rx, nd where t >= n_days - 252 and asset_idx < 10"))
def panel_slice(spark, sf_dir):
    return rounded(pn.slice_rows(returns(spark, sf_dir), 252, 10).select("t", "asset", "r"))


@_query("implausible_returns", _sql(f"select t, asset, {_r('r', 'r')} from rx where abs(r) >= 0.5"))
def implausible_returns(spark, sf_dir):
    return rounded(pn.suspicious(returns(spark, sf_dir)).select("t", "asset", "r"))


@_query("equal_weight_returns", _sql(f"select dt, {_r('exp(avg(r)) - 1', 'port_ret')} from ret group by dt"))
def equal_weight_returns(spark, sf_dir):
    return rounded(pn.equal_weight(pn.log_returns(pn.clean_prices(prices(spark, sf_dir)))))


def _equal(spark, sf_dir, panel="brand_week"):
    return pn.equal_weight(returns(spark, sf_dir, panel).select("t", "asset", "r"))


@_query("wealth_drawdown", _sql(f"select dt, {_r('wealth', 'wealth')}, {_r('peak', 'peak')}, {_r('(wealth - peak) / peak', 'drawdown')} from m_p join (select distinct t, dt from rx) d on d.t = m_p.t", _EQUAL, _metrics("ew", "", "m")))
def wealth_drawdown(spark, sf_dir):
    series = pn.equal_weight(returns(spark, sf_dir).select("t", "dt", "asset", "r"))
    return rounded(mt.drawdowns(series, []).select("dt", "wealth", "peak", "drawdown"))


@_query("metric_summary", _sql(f"select {_FIVE} from m", _EQUAL, _metrics("ew", "", "m")))
def metric_summary(spark, sf_dir):
    return rounded(mt.metric_summary(_equal(spark, sf_dir), []))


@_query(
    "metric_summary_log",
    _sql(
        f"select {_r('min((wealth - peak) / peak)', 'max_drawdown')}, {_r('pow(exp(sum(lr)), 252.0 / count(*)) - 1', 'cagr')} from p",
        "lr as (select t, avg(r) as lr from rx group by t)",
        "wl as (select *, exp(sum(lr) over (order by t rows between unbounded preceding and current row)) as wealth from lr)",
        "p as (select *, max(wealth) over (order by t rows between unbounded preceding and current row) as peak from wl)",
    ),
)
def metric_summary_log(spark, sf_dir):
    series = returns(spark, sf_dir).groupBy("t").agg(F.avg("r").alias("port_ret"))
    return rounded(mt.metric_summary(series, [], log=True).select("max_drawdown", "cagr"))


# --- configurations, calendars, windows ----------------------------------------------------------------------


@_query("config_grid", "with " + _CONFIGS + " select * from configs")
def config_grid(spark, sf_dir):
    return config_frame(spark, grid())


@_query("task_grid", "with " + _CONFIGS + " select config_idx, cast(boot as int) as bootstrap_idx, 7 * cast(1000003 as bigint) + config_idx * cast(997 as bigint) + boot as sub_seed from configs, (select unnest(range(0, 20)) as boot)")
def task_grid(spark, sf_dir):
    return bt.tasks(spark, config_frame(spark, grid()), 20, 7).select("config_idx", "bootstrap_idx", "sub_seed")


@_query("config_subset", "with " + _CONFIGS + " select config_idx, label from configs where lookback = 252 and rebalance_every = 21 and objective = 'min_variance'")
def config_subset(spark, sf_dir):
    return config_frame(spark, grid()).where("lookback = 252 and rebalance_every = 21 and objective = 'min_variance'").select("config_idx", "label")


@_query("union_routes", "with " + _CONFIGS + " select config_idx, case when objective = 'min_variance' then 'projected_gradient' else 'frank_wolfe' end as route from configs")
def union_routes(spark, sf_dir):
    configs = config_frame(spark, grid())
    route = lambda objective, name: configs.where(F.col("objective") == objective).select("config_idx", F.lit(name).alias("route"))
    return route("min_variance", "projected_gradient").unionByName(route("max_sharpe", "frank_wolfe"))


@_query(
    "rebalance_calendar",
    _sql("select config_idx, cast((t - lookback) // rebalance_every as int) as rb_seq, t as t_from, cast(least(t + rebalance_every, n_days) as int) as t_to from configs, nd, (select distinct t from rx) where t >= lookback and (t - lookback) % rebalance_every = 0", _SMALL),
)
def rebalance_calendar(spark, sf_dir):
    days, configs = ro.n_days(returns(spark, sf_dir)), config_frame(spark, grid(**GRID))
    both = configs.crossJoin(days).where("n_days > lookback").select("config_idx", "rebalance_every", "n_days", F.posexplode(F.sequence("lookback", F.col("n_days") - 1, "rebalance_every")).alias("rb_seq", "t_from"))
    return both.select("config_idx", "rb_seq", "t_from", F.least(F.col("t_from") + F.col("rebalance_every"), "n_days").alias("t_to"))


def _window(spark, sf_dir, panel="brand_week", lookback=LOOKBACK, every=EVERY):
    return ro.windows(returns(spark, sf_dir, panel), lookback, every)


@_query("window_gather", _sql("select rb_seq, count(*) as n_rows, min(t) as first_t, max(t) as last_t from win group by rb_seq", _win()))
def window_gather(spark, sf_dir):
    return _window(spark, sf_dir).groupBy("rb_seq").agg(F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@_query("window_mean", _sql(f"select rb_seq, asset_idx, {_r('mu', 'mu')} from mu", _win(), _MU))
def window_mean(spark, sf_dir):
    return rounded(ro.means(_window(spark, sf_dir)))


@_query("cov_sample", _sql(f"select rb_seq, i, j, {_r('cov', 'cov')} from cov", _win(), _COV))
def cov_sample(spark, sf_dir):
    return rounded(ro.estimate(_window(spark, sf_dir), "sample"))


@_query(
    "cov_ledoit_wolf",
    _sql(
        f"select b.rb_seq, i, j, {_r('(1 - alpha) * s + alpha * target', 'cov')}, {_r('alpha', 'alpha')} from tb b join al on al.rb_seq = b.rb_seq",
        _win(),
        _MU,
        "c as (select w.rb_seq, w.t, w.asset_idx, r - mu as c from win w join mu m on m.rb_seq = w.rb_seq and m.asset_idx = w.asset_idx)",
        "b as (select x.rb_seq, x.asset_idx as i, y.asset_idx as j, avg(x.c * y.c) as s, avg(x.c * x.c * y.c * y.c) as q, count(*) as n from c x join c y on x.rb_seq = y.rb_seq and x.t = y.t and x.asset_idx <= y.asset_idx group by 1, 2, 3)",
        "lv as (select rb_seq, avg(s) as m from b where i = j group by 1)",
        "tb as (select b.*, case when i = j then m else 0.0 end as target, case when i = j then 1.0 else 2.0 end as tw from b join lv on lv.rb_seq = b.rb_seq)",
        "su as (select rb_seq, sum(tw * (q - s * s)) as pi_, sum(tw * pow(s - target, 2)) as gamma_, max(n) as n from tb group by 1)",
        "al as (select rb_seq, case when gamma_ < 1e-12 then 0.0 else greatest(0.0, least(1.0, pi_ / gamma_ / n)) end as alpha from su)",
        panel="type_week",
    ),
)
def cov_ledoit_wolf(spark, sf_dir):
    return rounded(ro.ledoit_wolf(_window(spark, sf_dir, "type_week")))


@_query(
    "cov_ewma",
    _sql(
        f"select x.rb_seq, x.asset_idx as i, y.asset_idx as j, {_r('sum(x.w * x.c * y.c) / sum(x.w)', 'cov')} from c x join c y on x.rb_seq = y.rb_seq and x.t = y.t and x.asset_idx <= y.asset_idx group by 1, 2, 3",
        _win(),
        "wt as (select *, pow(0.94, age) as w from win)",
        "wm as (select rb_seq, asset_idx, sum(w * r) / sum(w) as m from wt group by 1, 2)",
        "c as (select wt.rb_seq, wt.t, wt.asset_idx, w, r - m as c from wt join wm on wm.rb_seq = wt.rb_seq and wm.asset_idx = wt.asset_idx)",
        panel="type_week",
    ),
)
def cov_ewma(spark, sf_dir):
    return rounded(ro.estimate(_window(spark, sf_dir, "type_week"), "ewma"))


@_query("infeasible_windows", _sql("select rb_seq, count(*) filter (where mu > 0) as n_positive, count(*) filter (where mu > 0) > 0 as feasible from mu group by rb_seq", _win(252, 21), _MU, panel="type_day"))
def infeasible_windows(spark, sf_dir):
    return ro.feasible(_window(spark, sf_dir, "type_day", 252, 21))


# --- portfolios ----------------------------------------------------------------------------------------------


@_query("simplex_projection", _sql(f"select rb_seq as key, asset_idx, {_r('w', 'w')} from w", _win(), _MU, _SIMPLEX))
def simplex_projection(spark, sf_dir):
    return rounded(pf.project_simplex(ro.means(_window(spark, sf_dir)), ["rb_seq"], "mu").withColumnRenamed("rb_seq", "key"))


_PICK = "two as (select rb_seq, max(cov) filter (where i = 0 and j = 0) + 1e-10 as c11, max(cov) filter (where i = 0 and j = 1) as c12, max(cov) filter (where i = 1 and j = 1) + 1e-10 as c22 from cov where i < 2 and j < 2 group by 1)"


@_query("min_variance_two_asset", _sql(f"select rb_seq, {_r('(c22 - c12) / nullif(c11 + c22 - 2 * c12, 0)', 'w1')}, {_r('(c11 - c12) / nullif(c11 + c22 - 2 * c12, 0)', 'w2')} from two", _win(), _COV, _PICK))
def min_variance_two_asset(spark, sf_dir):
    return rounded(pf.two_asset_min_variance(ro.cov_sample(_window(spark, sf_dir))))


@_query(
    "tangency_two_asset",
    _sql(
        f"select rb_seq, {_r('z1 / nullif(z1 + z2, 0)', 'w1')}, {_r('z2 / nullif(z1 + z2, 0)', 'w2')} from z",
        _win(),
        _COV,
        _MU,
        _PICK,
        "m as (select rb_seq, max(mu) filter (where asset_idx = 0) as m1, max(mu) filter (where asset_idx = 1) as m2 from mu where asset_idx < 2 group by 1)",
        "z as (select two.rb_seq, c22 * m1 - c12 * m2 as z1, c11 * m2 - c12 * m1 as z2 from two join m on m.rb_seq = two.rb_seq)",
    ),
)
def tangency_two_asset(spark, sf_dir):
    window = _window(spark, sf_dir)
    return rounded(pf.two_asset_tangency(ro.cov_sample(window), ro.means(window)))


_HELD = f"held as (select rx.t, sum(w * (exp(r) - 1)) as port_ret from rx join w on w.asset_idx = rx.asset_idx and w.rb_seq = (rx.t - {LOOKBACK}) // {EVERY} where rx.t >= {LOOKBACK} group by rx.t)"


def _inverse(spark, sf_dir):
    r = returns(spark, sf_dir)
    cov = ro.cov_sample(ro.windows(r, LOOKBACK, EVERY))
    return r, cov, pf.inverse_variance(cov)


@_query("hold_weights", _sql(f"select t, {_r('port_ret', 'port_ret')} from held", _win(), _COV, _INVERSE, _HELD))
def hold_weights(spark, sf_dir):
    r, _, w = _inverse(spark, sf_dir)
    return rounded(pf.hold(r, w, LOOKBACK, EVERY))


@_query("hold_weights_asof", _sql(f"select t, {_r('port_ret', 'port_ret')} from held", _win(), _COV, _INVERSE, _HELD))
def hold_weights_asof(spark, sf_dir):
    r, _, w = _inverse(spark, sf_dir)
    return rounded(pf.hold_asof(r.select("t", "asset_idx", "r"), w, ro.calendar(ro.n_days(r), LOOKBACK, EVERY)))


# Weekly unit prices jump about; this portfolio's growth has 48 digits, so its logarithm is compared.
_LOG_FIVE = ", ".join(_r(m, m) for m in mt.METRICS[:-1]) + ", " + _r("ln(1 + cagr)", "log_growth")


@_query("backtest_inverse_variance", _sql(f"select {_LOG_FIVE} from m", _win(), _COV, _INVERSE, _HELD, _metrics("held", "", "m")))
def backtest_inverse_variance(spark, sf_dir):
    r, _, w = _inverse(spark, sf_dir)
    found = mt.metric_summary(pf.hold(r, w, LOOKBACK, EVERY), [])
    return rounded(found.select(*mt.METRICS[:-1], F.log(1 + F.col("cagr")).alias("log_growth")))


_QUADRATIC = "a.rb_seq = c.rb_seq and a.asset_idx = c.i join w b on b.rb_seq = c.rb_seq and b.asset_idx = c.j"


@_query("portfolio_variance", _sql(f"select c.rb_seq, {_r('sum(a.w * cov * b.w)', 'var')} from full_cov c join w a on {_QUADRATIC} group by 1", _win(), _COV, _FULL, _INVERSE))
def portfolio_variance(spark, sf_dir):
    _, cov, w = _inverse(spark, sf_dir)
    return rounded(pf.variance(w, cov))


@_query(
    "portfolio_sharpe",
    _sql(
        f"select v.rb_seq, {_r('ret / sqrt(var)', 'sharpe')} from v join (select w.rb_seq, sum(w * mu) as ret from w join mu on mu.rb_seq = w.rb_seq and mu.asset_idx = w.asset_idx group by 1) x on x.rb_seq = v.rb_seq",
        _win(), _COV, _FULL, _INVERSE, _MU, f"v as (select c.rb_seq, sum(a.w * cov * b.w) as var from full_cov c join w a on {_QUADRATIC} group by 1)",
    ),
)
def portfolio_sharpe(spark, sf_dir):
    r, cov, w = _inverse(spark, sf_dir)
    return rounded(pf.sharpe(w, cov, ro.means(ro.windows(r, LOOKBACK, EVERY))))


@_query("weight_invariants", _sql(f"select rb_seq, {_r('sum(w)', 'sum_w')}, {_r('min(w)', 'min_w')}, count(*) filter (where w > 1e-6) as n_active from w group by 1", _win(), _MU, _SIMPLEX))
def weight_invariants(spark, sf_dir):
    return rounded(pf.invariants(pf.project_simplex(ro.means(_window(spark, sf_dir)), ["rb_seq"], "mu")))


@_query(
    "kkt_residual",
    _sql(
        f"""select rb_seq, {_r('max(g) filter (where w > 1e-6) - min(g) filter (where w > 1e-6)', 'spread')},
        {_r('coalesce(greatest(avg(g) filter (where w > 1e-6) - min(g) filter (where w <= 1e-6), 0.0), 0.0)', 'inactive_excess')} from g group by 1""",
        _win(), _COV, _FULL, _INVERSE,
        "g as (select c.rb_seq, c.i, max(a.w) as w, sum(cov * b.w) as g from full_cov c join w a on " + _QUADRATIC + " group by 1, 2)",
    ),
)
def kkt_residual(spark, sf_dir):
    _, cov, w = _inverse(spark, sf_dir)
    return rounded(pf.kkt(w, cov))


# --- bootstrap -----------------------------------------------------------------------------------------------


@_query("bootstrap_fixed_index", _sql("select * from ix", _fixed()))
def bootstrap_fixed_index(spark, sf_dir):
    return bs.fixed_index(ro.n_days(returns(spark, sf_dir)), BOOTS, BLOCK, SEED)


@_query("bootstrap_iid_index", _sql("select * from ix", _fixed(1)))
def bootstrap_iid_index(spark, sf_dir):
    return bs.iid_index(ro.n_days(returns(spark, sf_dir)), BOOTS, SEED)


@_query("bootstrap_stationary_index", _sql("select * from sx", _stationary()))
def bootstrap_stationary_index(spark, sf_dir):
    return bs.stationary_index(ro.n_days(returns(spark, sf_dir)), BOOTS, 20.0, SEED)


def _gathered(spark, sf_dir, mode="fixed"):
    r = returns(spark, sf_dir)
    index = bs.fixed_index if mode == "fixed" else bs.stationary_index
    return bs.gather(index(ro.n_days(r), BOOTS, BLOCK, SEED), r)


@_query("bootstrap_gather", _sql(f"select boot, pos, asset, {_r('r', 'r')} from ix join rx on rx.t = src_t", _fixed()))
def bootstrap_gather(spark, sf_dir):
    return rounded(_gathered(spark, sf_dir).select("boot", "pos", "asset", "r"))


@_query("bootstrap_moments", _sql(f"select asset, {_r('avg(r)', 'mean')}, {_r('stddev_pop(r)', 'std_pop')} from ix join rx on rx.t = src_t group by 1", _fixed()))
def bootstrap_moments(spark, sf_dir):
    return rounded(bs.moments(_gathered(spark, sf_dir)))


@_query(
    "lag1_autocorr",
    _sql(
        f"select a.asset, {_r('a.acf', 'acf')}, {_r('b.acf', 'acf_boot')} from a join b on a.asset = b.asset",
        _fixed(),
        "a as (select asset, corr(r, p) as acf from (select asset, r, lag(r) over (partition by asset order by t) as p from rx) where p is not null group by 1)",
        "b as (select asset, corr(r, p) as acf from (select asset, r, lag(r) over (partition by asset order by pos) as p from ix join rx on rx.t = src_t where boot = 0) where p is not null group by 1)",
    ),
)
def lag1_autocorr(spark, sf_dir):
    own = pn.lag1_autocorrelation(returns(spark, sf_dir), "r", ["asset"], "t")
    again = pn.lag1_autocorrelation(_gathered(spark, sf_dir).where("boot = 0"), "r", ["asset"], "pos").withColumnRenamed("acf", "acf_boot")
    return rounded(own.join(again, "asset"))


def _boot_metrics(spark, sf_dir, mode="fixed"):
    series = pn.equal_weight(_gathered(spark, sf_dir, mode).select("boot", F.col("pos").alias("t"), "asset", "r"))
    return mt.metric_summary(series, ["boot"])


@_query("bootstrap_equal_weight_metrics", _sql(f"select boot, {_FIVE} from m", _fixed(), _boot_equal("ix", "s"), _metrics("s", "boot", "m")))
def bootstrap_equal_weight_metrics(spark, sf_dir):
    return rounded(_boot_metrics(spark, sf_dir))


_SUMMARY = ", ".join(f"{_r(f'avg({m})', f'{m}_mean')}, {_r(f'quantile_cont({m}, 0.05)', f'{m}_p05')}, {_r(f'quantile_cont({m}, 0.95)', f'{m}_p95')}" for m in mt.METRICS)


@_query("bootstrap_summary", _sql(f"select {_SUMMARY} from m", _fixed(), _boot_equal("ix", "s"), _metrics("s", "boot", "m")))
def bootstrap_summary(spark, sf_dir):
    return rounded(mt.summarise(_boot_metrics(spark, sf_dir), []))


@_query(
    "max_abs_diff",
    _sql(
        "unpivot (select " + ", ".join(_r(f"max(abs(a.{m} - b.{m}))", m) for m in mt.METRICS) + " from a join b on a.boot = b.boot) on " + ", ".join(mt.METRICS) + " into name metric value max_diff",
        _fixed(), _stationary(), _boot_equal("ix", "s"), _boot_equal("sx", "s2"), _metrics("s", "boot", "a"), _metrics("s2", "boot", "b"),
    ),
)
def max_abs_diff(spark, sf_dir):
    return rounded(mt.max_abs_diff(_boot_metrics(spark, sf_dir), _boot_metrics(spark, sf_dir, "stationary"), ["boot"]))


@_query(
    "worst_k_difference",
    _sql(
        f"select a.boot, {_r('abs(a.sharpe - b.sharpe) / greatest(abs(a.sharpe), 1e-12)', 'rel_diff')} from a join b on a.boot = b.boot order by 2 desc, 1 limit 3",
        _fixed(), _stationary(), _boot_equal("ix", "s"), _boot_equal("sx", "s2"), _metrics("s", "boot", "a"), _metrics("s2", "boot", "b"),
    ),
)
def worst_k_difference(spark, sf_dir):
    return rounded(mt.worst_differences(_boot_metrics(spark, sf_dir), _boot_metrics(spark, sf_dir, "stationary"), ["boot"], "sharpe", 3))


def _config_series(spark, sf_dir):
    """Equal-weight returns of every configuration (from its lookback on) and replicate."""
    series = pn.equal_weight(_gathered(spark, sf_dir).select("boot", F.col("pos").alias("t"), "asset", "r"))
    configs = config_frame(spark, grid(**GRID)).select("config_idx", "label", "estimator", "objective", "lookback", "rebalance_every")
    return mt.metric_summary(configs.crossJoin(series).where("t >= lookback"), ["config_idx", "label", "estimator", "objective", "lookback", "rebalance_every", "boot"])


_KEYS = "config_idx, label, estimator, objective, lookback, rebalance_every, boot"
_RAW = (_SMALL, _fixed(), _boot_equal("ix", "s"), "cs as (select configs.*, boot, t, port_ret from configs, s where t >= lookback)", _metrics("cs", _KEYS, "m"))


@_query("strategy_raw", _sql(f"select config_idx, boot as bootstrap_idx, {_FIVE} from m", *_RAW))
def strategy_raw(spark, sf_dir):
    return rounded(_config_series(spark, sf_dir).select("config_idx", F.col("boot").alias("bootstrap_idx"), *mt.METRICS))


@_query("metrics_per_config", _sql(f"select config_idx, label, {_SUMMARY} from m group by 1, 2", *_RAW))
def metrics_per_config(spark, sf_dir):
    return rounded(mt.summarise(_config_series(spark, sf_dir), ["config_idx", "label"]))


@_query(
    "strategy_report",
    _sql(
        f"""select label, estimator, objective, lookback, rebalance_every, {_r('avg(sharpe)', 'sharpe_mean')}, {_r('quantile_cont(sharpe, 0.05)', 'sharpe_p05')}, {_r('quantile_cont(sharpe, 0.95)', 'sharpe_p95')},
        {_r('avg(annual_vol)', 'annual_vol_mean')}, {_r('avg(max_drawdown)', 'max_dd_mean')}, {_r('avg(cagr)', 'cagr_mean')} from m group by 1, 2, 3, 4, 5""",
        *_RAW,
    ),
)
def strategy_report(spark, sf_dir):
    return rounded(mt.strategy_report(_config_series(spark, sf_dir)))


@_query(
    "top_bottom_sharpe",
    _sql(
        f"""select * from (select label, {_r('sharpe', 'sharpe')}, 'top' as side from m where boot = 0 order by m.sharpe desc, config_idx limit 5)
        union all select * from (select label, {_r('sharpe', 'sharpe')}, 'bottom' as side from m where boot = 0 order by m.sharpe, config_idx limit 5)""",
        *_RAW,
    ),
)
def top_bottom_sharpe(spark, sf_dir):
    raw = _config_series(spark, sf_dir).where("boot = 0")
    return rounded(mt.top_and_bottom(raw).select("label", "sharpe", "side"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations, five resamples of the daily event panel."""
    configs = [Config("ledoit_wolf", "min_variance", 10, 5), Config("ledoit_wolf", "max_sharpe", 10, 5)]
    return bt.bootstrap(spark, returns(spark, sf_dir, "event_day"), configs, n_bootstrap=5, block_size=5).raw_metrics
