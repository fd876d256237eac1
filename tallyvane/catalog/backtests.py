"""Queries over backtest runs: one run per sector, or a grid of three per sector."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyvane.catalog.common import day_text, rnd, sql_day, sql_rnd
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.operators import backtest as bt
from tallyvane.operators import evaluation, snapshots
from tallyvane.operators.materialize import materialize
from tallyvane.plans import backtests as plan

START, END = dt.datetime(1996, 1, 1), dt.datetime(2001, 6, 30)

add_view("ew_prices", "bars companies", """
    SELECT r_regionkey AS run_id, 100000.0 + r_regionkey * 5000 AS capital, ticker, ts, close
    FROM bars JOIN companies USING (company_id) JOIN region ON r_name = sector
    WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-06-30'""")
add_view("ew_buys", "ew_prices", """
    SELECT p.*, capital / count(*) OVER (PARTITION BY run_id) / close AS shares FROM ew_prices p
    JOIN (SELECT run_id, min(ts) AS ts FROM ew_prices GROUP BY 1) USING (run_id, ts)""")
add_view("ew_curve", "ew_prices ew_buys", """
    SELECT d.run_id, d.ts, any_value(d.capital) AS capital, round(sum(shares * p.close), 2) AS value
    FROM (SELECT DISTINCT x.run_id, x.capital, x.ts, b.ticker, b.shares FROM (SELECT DISTINCT run_id, capital, ts FROM ew_prices) x
          JOIN ew_buys b USING (run_id)) d
    ASOF JOIN ew_prices p ON p.run_id = d.run_id AND p.ticker = d.ticker AND d.ts >= p.ts GROUP BY d.run_id, d.ts""")
add_view("ew_perf", "ew_curve", """
    SELECT run_id, (f - capital) / capital AS total_return, pow(f / capital, 252 / n) - 1 AS annualized_return, vol AS volatility,
           CASE WHEN vol > 0 THEN mean * 252 / vol ELSE 0 END AS sharpe_ratio, dd AS max_drawdown, f AS final_capital FROM (
      SELECT run_id, any_value(capital) AS capital, arg_max(value, ts) AS f, count(*) AS n, stddev_samp(ret) * sqrt(252) AS vol,
             avg(ret) AS mean, abs(min(value / peak - 1)) AS dd
      FROM (SELECT *, value / lag(value) OVER w - 1 AS ret, max(value) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak
            FROM ew_curve WINDOW w AS (PARTITION BY run_id ORDER BY ts)) GROUP BY run_id)""")


def sector_runs(m):
    """One equal-weight run per region: capital 100000 plus 5000 per region key."""
    return m.table("region").select(
        F.col("r_regionkey").cast("long").alias("run_id"), F.col("r_name").alias("sector"),
        (100000.0 + F.col("r_regionkey") * 5000).alias("initial_capital"))


def sector_prices(m):
    bars = m.bars(since=START, until=END).join(m.companies().select("company_id", "ticker", "sector"), "company_id")
    return materialize(bars.join(sector_runs(m).select("run_id", "sector"), "sector")
                       .select("run_id", "ticker", "ts", "close"))


def equal_weight(m):
    runs, prices = sector_runs(m), sector_prices(m)
    dates, picks = bt.equal_weight_picks(prices)
    trades, _ = bt.trades_of(runs, prices, dates, picks)
    return runs, prices, dates, trades


@query("equal_weight_trades", "K12 K17 A5", with_views("ew_buys ew_prices", f"""
    SELECT run_id::BIGINT AS run_id, ticker, {sql_day("ts")}, 'BUY' AS action, close AS price, round(shares, 6) AS shares, round(shares * close, 4) AS amount FROM ew_buys
    UNION ALL SELECT b.run_id::BIGINT, b.ticker, strftime(l.ts, '%Y-%m-%d'), 'SELL', l.close, round(shares, 6), round(shares * l.close, 4)
    FROM ew_buys b JOIN ew_prices l ON l.run_id = b.run_id AND l.ticker = b.ticker
    JOIN (SELECT run_id, ticker, max(ts) AS ts FROM ew_prices GROUP BY ALL) k ON k.run_id = l.run_id AND k.ticker = l.ticker AND k.ts = l.ts"""))
def equal_weight_trades(m):
    t = equal_weight(m)[3]
    return t.select("run_id", "ticker", day_text("ts"), "action", "price", *rnd("shares"), *rnd("amount", digits=4))


@query("equal_weight_equity", "K12 G16 F27", with_views("ew_curve", f"""
    SELECT run_id::BIGINT AS run_id, {sql_day("ts")}, round(value, 1) AS value, round(value / capital - 1, 4) AS gain FROM ew_curve"""))
def equal_weight_equity(m):
    runs, prices, dates, trades = equal_weight(m)
    curve = bt.equity_curve(runs, prices, trades)
    gain = bt.gain_since_start(runs, curve)
    return curve.join(gain, ["run_id", "ts"]).select("run_id", day_text("ts"), *rnd("value", digits=1), *rnd("gain", digits=4))


_PERF = ["total_return", "annualized_return", "volatility", "sharpe_ratio", "max_drawdown"]


@query("equal_weight_performance", "F16 F17", with_views("ew_perf ew_buys ew_prices", f"""
    SELECT run_id::BIGINT AS run_id, {sql_rnd(*_PERF, digits=5)}, round(win_rate, 6) AS win_rate, total_trades, round(final_capital, 1) AS final_capital
    FROM ew_perf JOIN (SELECT b.run_id, count(*) * 2 AS total_trades, avg((l.c > b.close)::INT) AS win_rate FROM ew_buys b
      JOIN (SELECT run_id, ticker, arg_max(close, ts) AS c FROM ew_prices GROUP BY ALL) l ON l.run_id = b.run_id AND l.ticker = b.ticker GROUP BY 1) USING (run_id)"""))
def equal_weight_performance(m):
    runs, prices, dates, trades = equal_weight(m)
    p = bt.performance(runs, bt.equity_curve(runs, prices, trades), trades)
    return p.select("run_id", *rnd(*_PERF, digits=5), *rnd("win_rate"), "total_trades", *rnd("final_capital", digits=1))


_CMP = ["strategy_return", "benchmark_return", "alpha", "beta", "tracking_error", "information_ratio"]


@query("equal_weight_benchmark", "F18 E11", with_views("ew_curve bars", f"""
    SELECT run_id::BIGINT AS run_id, {sql_rnd(*_CMP, digits=5)}, strategy_return > benchmark_return AS outperformed FROM (
      SELECT run_id, sr AS strategy_return, br AS benchmark_return, sr - br AS alpha, beta, te AS tracking_error, md * 252 / te AS information_ratio FROM (
        SELECT s.run_id, covar_samp(s.ret, b.ret) / var_samp(b.ret) AS beta, stddev_pop(s.ret - b.ret) * sqrt(252) AS te, avg(s.ret - b.ret) AS md
        FROM (SELECT *, value / lag(value) OVER (PARTITION BY run_id ORDER BY ts) - 1 AS ret FROM ew_curve) s
        JOIN (SELECT *, close / lag(close) OVER (ORDER BY ts) - 1 AS ret FROM bars WHERE company_id = 1
              AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-06-30') b ON b.ts = s.ts WHERE s.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1)
      JOIN (SELECT run_id, (arg_max(value, ts) - arg_min(value, ts)) / arg_min(value, ts) AS sr FROM ew_curve GROUP BY 1) USING (run_id),
      (SELECT (arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) AS br FROM bars WHERE company_id = 1
       AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-06-30'))"""))
def equal_weight_benchmark(m):
    """Against the bars of company 1, the benchmark ticker of these runs."""
    runs, prices, dates, trades = equal_weight(m)
    curve = bt.equity_curve(runs, prices, trades)
    bench = m.bars(since=START, until=END).filter("company_id = 1").select("ts", "close")
    run_ids = runs.agg(F.collect_set("run_id").alias("ids")).scalar()
    bench = bench.withColumn("run_id", F.explode(run_ids))
    return bt.benchmark_comparison(curve, bench).select("run_id", *rnd(*_CMP, digits=5), "outperformed")


def grid(m):
    """Three parameter sets per region and strategy; every twentieth run is not queued."""
    r = F.col("r_regionkey")
    sets = F.explode(F.array(
        F.struct(F.lit(0).alias("j"), F.lit(21).alias("rebalance_days"), F.lit(5).alias("top_n"), F.lit(60).alias("lookback"),
                 F.lit(65.0).alias("threshold"), F.lit("moderate").alias("risk_profile")),
        F.struct(F.lit(1).alias("j"), F.lit(42).alias("rebalance_days"), F.lit(3).alias("top_n"), F.lit(20).alias("lookback"),
                 F.lit(75.0).alias("threshold"), F.lit("conservative").alias("risk_profile")),
        F.struct(F.lit(2).alias("j"), F.lit(63).alias("rebalance_days"), F.lit(8).alias("top_n"), F.lit(126).alias("lookback"),
                 F.lit(55.0).alias("threshold"), F.lit("aggressive").alias("risk_profile"))))
    names = ("score_threshold", "momentum", "equal_weight", "portfolio_optimizer")
    s = F.posexplode(F.array(*[F.lit(n) for n in names]))
    specs = m.table("region").select(r.alias("rk"), F.col("r_name").alias("sector"), sets.alias("p")).select("rk", "sector", "p.*")
    specs = specs.select("*", s.alias("si", "strategy"))
    run_id = (F.col("rk") * 100 + F.col("j") * 10 + F.col("si")).cast("long")
    return specs.select(
        run_id.alias("run_id"), "strategy", F.when((F.col("rk") == 4) & (F.col("j") == 2), "draft").otherwise("queued").alias("status"),
        "sector", F.lit(START).alias("start_date"), F.lit(END).alias("end_date"),
        (100000.0 + run_id * 100).alias("initial_capital"), "rebalance_days", "top_n", "lookback", "threshold",
        "risk_profile", F.lit(0.15).alias("max_position_weight"), F.lit(0.30).alias("max_sector_weight"))


def score_history(m):
    return m.scores().join(m.companies().select("company_id", "ticker"), "company_id").select(
        "ticker", F.col("ts").alias("score_ts"), F.col("overall_score").alias("score"), F.col("risk_score").alias("risk"))


def grid_result(m):
    return plan.execute(grid(m), m.bars(since=START, until=END), m.companies(), score_history(m))


@query("backtest_grid_status", "K16 N10", """
    SELECT (r_regionkey * 100 + j * 10 + si)::BIGINT AS run_id, strategy, 'completed' AS status
    FROM region, range(3) t(j), (VALUES (0, 'score_threshold'), (1, 'momentum'), (2, 'equal_weight'), (3, 'portfolio_optimizer')) s(si, strategy)
    WHERE NOT (r_regionkey = 4 AND j = 2)""")
def backtest_grid_status(m):
    return grid_result(m).status.select("run_id", "strategy", "status")


@query("backtest_grid_performance", "K13 K14 K15 K16 F16 F17 N10")
def backtest_grid_performance(m):
    """Path dependent; checked against a day-by-day simulation in the tests."""
    return grid_result(m).performance.select("run_id", *rnd(*_PERF, "win_rate", digits=5), "total_trades", "final_capital")


add_view("mom_dates", "ew_prices", """
    SELECT run_id, ts, pos // 21 AS k FROM (SELECT run_id, ts, row_number() OVER (PARTITION BY run_id ORDER BY ts) - 1 AS pos
      FROM (SELECT DISTINCT run_id, ts FROM ew_prices)) WHERE pos % 21 = 0""")
add_view("mom_ranked", "ew_prices mom_dates", """
    SELECT * FROM (SELECT r.*, k, row_number() OVER (PARTITION BY r.run_id, r.ts ORDER BY (close - past) / past DESC, ticker) AS rank FROM (
      SELECT *, lag(close, 60) OVER (PARTITION BY run_id, ticker ORDER BY ts) AS past FROM ew_prices) r
      JOIN mom_dates d ON d.run_id = r.run_id AND d.ts = r.ts WHERE past > 0) WHERE rank <= 5""")


@query("momentum_picks", "K13 G17 H8 G19", with_views("mom_ranked", f"""
    SELECT run_id::BIGINT AS run_id, {sql_day("ts")}, ticker, rank FROM mom_ranked"""))
def momentum_picks(m):
    prices = sector_prices(m).withColumns({"lookback": F.lit(60), "top_n": F.lit(5)})
    picks = bt.momentum_picks(prices, bt.rebalance_dates(prices, 21))
    return picks.select("run_id", day_text("ts"), "ticker", "rank")


@query("momentum_position_sizes", "K13", with_views("mom_ranked ew_prices mom_dates", """
    , bar_at AS (SELECT p.run_id, p.ticker, p.close AS price, d.k, r.ticker IS NOT NULL AS picked
             FROM ew_prices p JOIN mom_dates d ON d.run_id = p.run_id AND d.ts = p.ts
             LEFT JOIN mom_ranked r ON r.run_id = p.run_id AND r.ts = p.ts AND r.ticker = p.ticker),
    ep AS (SELECT *, sum((picked AND NOT was)::INT) OVER (PARTITION BY run_id, ticker ORDER BY k) AS e FROM (
             SELECT *, coalesce(lag(picked) OVER (PARTITION BY run_id, ticker ORDER BY k), false) AS was FROM bar_at)),
    growth AS (SELECT s.run_id, s.k, b.k AS b, sum(s.price / b.price) AS g FROM ep s
               JOIN ep b ON b.run_id = s.run_id AND b.ticker = s.ticker AND b.e = s.e AND b.picked
               WHERE NOT s.picked AND s.was GROUP BY ALL),
    grow AS (SELECT run_id, k, map(list(b ORDER BY b), list(g ORDER BY b)) AS g FROM growth GROUP BY ALL),
    steps AS (SELECT d.run_id, d.k, coalesce(n, 0) AS n, g, row_number() OVER (PARTITION BY d.run_id ORDER BY d.k) AS i
              FROM (SELECT DISTINCT run_id, k FROM ep WHERE picked OR was) d
              LEFT JOIN (SELECT run_id, k, count(*) AS n FROM ep WHERE picked GROUP BY ALL) c ON c.run_id = d.run_id AND c.k = d.k
              LEFT JOIN grow ON grow.run_id = d.run_id AND grow.k = d.k),
    fold AS (SELECT run_id, 0::BIGINT AS i, -1::BIGINT AS k, (100000.0 + run_id * 5000)::DOUBLE AS rest, 0::DOUBLE AS size, MAP([-1::BIGINT], [0::DOUBLE]) AS sizes
               FROM (SELECT DISTINCT run_id FROM steps)
             UNION ALL
             SELECT run_id, i, k, CASE WHEN n > 0 AND cash > 1e-9 THEN 0 ELSE cash END, CASE WHEN n > 0 AND cash > 1e-9 THEN cash / n ELSE 0 END,
                    map_concat(sizes, MAP([k], [CASE WHEN n > 0 AND cash > 1e-9 THEN cash / n ELSE 0 END]))
             FROM (SELECT s.run_id, s.i, s.k, s.n, f.sizes,
                     f.rest + coalesce(list_sum(list_transform(map_entries(s.g), lambda e: e.value * coalesce(f.sizes[e.key], 0))), 0) AS cash
                   FROM fold f JOIN steps s ON s.run_id = f.run_id AND s.i = f.i + 1))
    SELECT run_id::BIGINT AS run_id, k::INTEGER AS k, round(size, 3) AS size FROM fold WHERE i > 0""", recursive=True))
def momentum_position_sizes(m):
    """Cash put into each position at every rebalance of the momentum runs."""
    prices = sector_prices(m).withColumns({"lookback": F.lit(60), "top_n": F.lit(5)})
    dates = bt.rebalance_dates(prices, 21)
    _, sizes = bt.trades_of(sector_runs(m), prices, dates, bt.momentum_picks(prices, dates))
    return sizes.select("run_id", "k", *rnd("size", digits=3))


@query("score_threshold_picks", "K14 E6", with_views("ew_prices mom_dates scores companies", f"""
    SELECT d.run_id::BIGINT AS run_id, {sql_day("p.ts", "ts")}, p.ticker, score FROM ew_prices p JOIN mom_dates d ON d.run_id = p.run_id AND d.ts = p.ts
    ASOF JOIN (SELECT ticker, ts AS score_ts, overall_score AS score FROM scores JOIN companies USING (company_id)
               WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-06-30') s ON s.ticker = p.ticker AND p.ts >= score_ts WHERE score >= 65"""))
def score_threshold_picks(m):
    prices = sector_prices(m).withColumn("threshold", F.lit(65.0))
    scores = prices.select("run_id", "ticker").distinct().join(score_history(m), "ticker").filter(
        F.col("score_ts").between(F.lit(START), F.lit(END)))
    picks = bt.score_picks(prices, bt.rebalance_dates(prices, 21), scores)
    return picks.select("run_id", day_text("ts"), "ticker", "score")


@query("evaluated_scores", "F19 J22 H11", with_views("forward", f"""
    SELECT company_id, {sql_day("ts")}, round(return_1m, 6) AS return_1m, round(return_3m, 6) AS return_3m, round(return_6m, 6) AS return_6m,
           CASE WHEN return_3m > 0.05 THEN 'POSITIVE' WHEN return_3m < -0.05 THEN 'NEGATIVE' WHEN return_3m IS NOT NULL THEN 'NEUTRAL' END AS actual_outcome
    FROM forward"""))
def evaluated_scores(m):
    out = evaluation.evaluate_scores(m.scores(), m.bars())
    return out.select("company_id", day_text("ts"), *rnd("return_1m", "return_3m", "return_6m"), "actual_outcome")


add_view("ai_rows", "analyses bars", """
    SELECT analysis_id, a.company_id, direction, source_count, completed_at - INTERVAL 200 DAY AS created_at, b.ts AS base_ts, b.close AS base_close,
           CASE WHEN analysis_id % 2 = 0 THEN CASE WHEN direction <> 'sideways' THEN direction END
                WHEN direction IN ('bullish', 'bearish') THEN direction ELSE 'neutral' END AS llm_direction
    FROM analyses a ASOF JOIN bars b ON b.company_id = a.company_id AND a.completed_at - INTERVAL 200 DAY <= b.ts
    WHERE status = 'completed'""")
add_view("ai_eval", "ai_rows bars", """
    SELECT r.*, CASE WHEN e.ts >= base_ts AND date_diff('second', e.ts, created_at + INTERVAL 91 DAY) <= 432000
                     THEN (e.close - base_close) / base_close END AS forward_return
    FROM ai_rows r ASOF LEFT JOIN bars e ON e.company_id = r.company_id AND r.created_at + INTERVAL 91 DAY >= e.ts""")


@query("evaluated_analyses", "F19 J22", with_views("ai_eval", """
    SELECT analysis_id, llm_direction, round(forward_return, 6) AS forward_return, actual AS actual_direction,
           CASE WHEN actual IS NOT NULL AND llm_direction IS NOT NULL
                THEN actual = CASE llm_direction WHEN 'bullish' THEN 'up' WHEN 'bearish' THEN 'down' ELSE 'flat' END END AS direction_accuracy,
           source_count > 0 AS source_backed
    FROM (SELECT *, CASE WHEN forward_return > 0.02 THEN 'up' WHEN forward_return < -0.02 THEN 'down' WHEN forward_return IS NOT NULL THEN 'flat' END AS actual FROM ai_eval)"""))
def evaluated_analyses(m):
    """Analyses moved back 200 days; even ones state a field, odd ones a sentence."""
    said = F.parse_json(F.to_json(F.when(F.col("analysis_id") % 2 == 0, F.struct(F.col("direction").alias("direction")))))
    free = F.parse_json(F.concat(F.lit('"The tone is '), F.upper("direction"), F.lit(' today"')))
    a = m.analyses().withColumn("mi", F.when(F.col("analysis_id") % 2 == 0, said).otherwise(free)).select(
        "analysis_id", "company_id", "status",
        F.timestamp_seconds(F.unix_timestamp("completed_at") - 200 * 86400).alias("created_at"),
        evaluation.stated_direction("mi").alias("llm_direction"), "llm_confidence",
        F.col("source_count").alias("evidence_count"))
    out = evaluation.evaluate_analyses(a, m.bars())
    return out.select("analysis_id", "llm_direction", *rnd("forward_return"), "actual_direction", "direction_accuracy", "source_backed")


@query("snapshot_roundtrip", "A6", with_views("bars companies", f"""
    SELECT ticker, {sql_day("ts")}, close, volume FROM bars JOIN companies USING (company_id)
    WHERE ts BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-06-30'"""))
def snapshot_roundtrip(m):
    """Bars packed as a snapshot of mid 2000, then read back for a later-ending period."""
    as_of = dt.datetime(2000, 6, 30)
    snap = snapshots.snapshot_prices(m.bars(until=as_of), m.companies(), F.lit(as_of))
    rows = snapshots.read_snapshot(snap, F.lit(dt.datetime(1999, 1, 1)), F.lit(END))
    return rows.select("ticker", day_text("ts"), "close", "volume")


@query("snapshot_scores", "A6", with_views("scores companies", f"""
    SELECT ticker, {sql_day("ts")}, overall_score FROM scores JOIN companies USING (company_id) WHERE ts <= TIMESTAMP '2000-06-30'
    QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY ts DESC) = 1"""))
def snapshot_scores(m):
    return snapshots.snapshot_scores(m.scores(), m.companies(), F.lit(dt.datetime(2000, 6, 30))).select(
        "ticker", day_text("ts"), "overall_score")


@query("snapshot_coverage", "J23", """
    SELECT o_orderkey AS run_id, CASE WHEN NOT pinned THEN 'unpinned' WHEN scored OR src = 'live' THEN 'partially_pinned' ELSE 'pinned' END AS mode,
           CASE WHEN NOT pinned THEN '' WHEN src = 'snapshot' THEN 'prices,benchmark' ELSE 'prices' END AS pinned,
           concat_ws(',', CASE WHEN NOT pinned THEN 'prices,benchmark' END, CASE WHEN scored THEN 'score_history' END, CASE WHEN pinned AND src = 'live' THEN 'benchmark' END) AS live
    FROM (SELECT o_orderkey, o_orderkey % 4 IN (0, 3) AS scored, o_orderkey % 5 > 1 AS pinned, (['snapshot', 'live', 'none'])[o_orderkey % 3 + 1] AS src FROM orders)""")
def snapshot_coverage(m):
    """One run per order over the four strategies, pinned or not, with each benchmark source."""
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    runs = m.table("orders").select(
        k.alias("run_id"), pick(("score_threshold", "momentum", "equal_weight", "portfolio_optimizer"), 4).alias("strategy"),
        F.when(k % 5 > 1, k).alias("snapshot_id"), pick(("snapshot", "live", "none"), 3).alias("benchmark_source"))
    c = bt.coverage(runs)
    return c.select("run_id", "mode", F.array_join("pinned", ",").alias("pinned"), F.array_join("live", ",").alias("live"))
