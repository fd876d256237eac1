"""Queries over stored backtest runs and snapshots: written, written again, and read back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tallyvane.catalog.backtests import _CMP, _PERF, END, START
from tallyvane.catalog.common import day_text, rnd, sql_day, sql_rnd
from tallyvane.catalog.registry import QUERIES, query
from tallyvane.catalog.sqlviews import VIEWS, add_view, with_views
from tallyvane.operators import snapshots
from tallyvane.operators.materialize import shared_folder, stored
from tallyvane.plans import run_store as rs

SNAPSHOT = dt.datetime(2000, 6, 30)

# kinds: 0 a region, 1 a region pinned to the snapshot, 2 all companies, 3 unknown benchmark, 4 missing snapshot, 5 a period without prices
add_view("rs_specs", "", """
    SELECT (kind * 10 + r_regionkey)::BIGINT AS run_id, kind, CASE WHEN kind = 2 THEN NULL ELSE r_name END AS sector, 100000.0 + r_regionkey * 5000 AS capital,
           CASE WHEN kind = 5 THEN TIMESTAMP '1980-01-01' ELSE TIMESTAMP '1996-01-01' END AS lo,
           CASE WHEN kind = 5 THEN TIMESTAMP '1981-01-01' ELSE TIMESTAMP '2001-06-30' END AS hi
    FROM region, range(6) k(kind) WHERE kind < 2 OR (kind IN (2, 3) AND r_regionkey = 0) OR (kind = 4 AND r_regionkey = 1) OR (kind = 5 AND r_regionkey = 2)""")
add_view("rs_prices", "bars companies rs_specs", """
    SELECT run_id, capital, ticker, ts, close FROM bars JOIN companies c USING (company_id) JOIN rs_specs s ON s.sector IS NULL OR s.sector = c.sector
    WHERE ts BETWEEN lo AND hi AND kind <> 4 AND (kind <> 1 OR ts <= TIMESTAMP '2000-06-30')""")
for _name, _deps in (("buys", "rs_prices"), ("curve", "rs_prices rs_buys"), ("perf", "rs_curve")):
    add_view(f"rs_{_name}", _deps, VIEWS[f"ew_{_name}"][1].replace("ew_", "rs_"))
add_view("rs_bench", "rs_specs rs_prices bars", """
    SELECT run_id, ts, close, CASE WHEN kind = 1 THEN 'snapshot' ELSE 'live' END AS source FROM rs_specs JOIN bars ON ts BETWEEN lo AND hi
    WHERE company_id = 1 AND kind <> 3 AND (kind <> 1 OR ts <= TIMESTAMP '2000-06-30') AND run_id IN (SELECT run_id FROM rs_prices)""")
add_view("rs_compare", "rs_curve rs_bench", """
    SELECT run_id, sr AS strategy_return, br AS benchmark_return, sr - br AS alpha, beta, te AS tracking_error, md * 252 / te AS information_ratio FROM (
      SELECT s.run_id, covar_samp(s.ret, b.ret) / var_samp(b.ret) AS beta, stddev_pop(s.ret - b.ret) * sqrt(252) AS te, avg(s.ret - b.ret) AS md
      FROM (SELECT *, value / lag(value) OVER (PARTITION BY run_id ORDER BY ts) - 1 AS ret FROM rs_curve) s
      JOIN (SELECT *, close / lag(close) OVER (PARTITION BY run_id ORDER BY ts) - 1 AS ret FROM rs_bench) b ON b.run_id = s.run_id AND b.ts = s.ts
      WHERE s.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1)
    JOIN (SELECT run_id, (arg_max(value, ts) - arg_min(value, ts)) / arg_min(value, ts) AS sr FROM rs_curve GROUP BY 1) USING (run_id)
    JOIN (SELECT run_id, (arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) AS br FROM rs_bench GROUP BY 1) USING (run_id)""")
add_view("rs_trades", "rs_buys rs_prices", """
    SELECT run_id, ticker, ts, 'BUY' AS action, close AS price, shares, shares * close AS amount FROM rs_buys
    UNION ALL SELECT b.run_id, b.ticker, l.ts, 'SELL', l.close, shares, shares * l.close FROM rs_buys b
    JOIN (SELECT run_id, ticker, max(ts) AS ts, arg_max(close, ts) AS close FROM rs_prices GROUP BY ALL) l USING (run_id, ticker)""")


# trades of the momentum runs 60 to 64, from the sizes that their own query states
_sizes = QUERIES["momentum_position_sizes"].sql
_MOMENTUM = _sizes[_sizes.index(", bar_at AS"):_sizes.rindex("SELECT run_id::BIGINT")] + """
    , mb AS (SELECT ep.run_id, ticker, e, d.ts FROM ep JOIN mom_dates d USING (run_id, k) JOIN fold USING (run_id, k) WHERE picked AND size > 1e-9 AND i > 0),
    ms AS (SELECT ep.run_id, ticker, e, d.ts FROM ep JOIN mom_dates d USING (run_id, k) JOIN (SELECT DISTINCT run_id, ticker, e FROM mb) USING (run_id, ticker, e)
           WHERE was AND NOT picked),
    ml AS (SELECT run_id, ticker, max(ts) AS ts FROM ew_prices GROUP BY ALL),
    all_trades AS (
      SELECT run_id, ticker, ts, action FROM rs_trades UNION ALL SELECT run_id + 60, ticker, ts, 'BUY' FROM mb UNION ALL SELECT run_id + 60, ticker, ts, 'SELL' FROM ms
      UNION ALL SELECT run_id + 60, ticker, ml.ts, 'SELL' FROM (SELECT DISTINCT run_id, ticker, e FROM mb) ANTI JOIN ms USING (run_id, ticker, e) JOIN ml USING (run_id, ticker)),
    all_runs AS (SELECT run_id, kind FROM rs_specs UNION ALL SELECT r_regionkey + 60, 6 FROM region)"""


def _with_momentum(body):
    return with_views("rs_specs rs_perf rs_compare rs_trades mom_ranked ew_prices mom_dates", _MOMENTUM + body, recursive=True)


def specs(m, momentum=False):
    """Equal-weight runs of all regions, live and pinned, and runs for each way to go without something; on demand momentum runs too."""
    r = F.col("r_regionkey")
    kind = F.explode(F.array_compact(F.array(
        F.lit(0), F.lit(1), F.when(r == 0, 2), F.when(r == 0, 3), F.when(r == 1, 4), F.when(r == 2, 5),
        F.lit(6) if momentum else F.lit(None).cast("int")))).alias("kind")
    rows = m.table("region").select(r.alias("r"), "r_name", kind)
    empty = F.col("kind") == 5
    return rows.select(
        (F.col("kind") * 10 + F.col("r")).cast("long").alias("run_id"),
        F.when(F.col("kind") == 6, "momentum").otherwise("equal_weight").alias("strategy"), F.lit("queued").alias("status"),
        F.when(F.col("kind") != 2, F.col("r_name")).alias("sector"),
        F.when(empty, F.lit(dt.datetime(1980, 1, 1))).otherwise(F.lit(START)).alias("start_date"),
        F.when(empty, F.lit(dt.datetime(1981, 1, 1))).otherwise(F.lit(END)).alias("end_date"),
        (100000.0 + F.col("r") * 5000).alias("initial_capital"), F.lit(21).alias("rebalance_days"), F.lit(5).alias("top_n"),
        F.lit(60).alias("lookback"), F.lit(65.0).alias("threshold"), F.lit("moderate").alias("risk_profile"),
        F.lit(0.15).alias("max_position_weight"), F.lit(0.30).alias("max_sector_weight"),
        F.when(F.col("kind") == 3, "none").otherwise("s1").alias("benchmark_ticker"),
        F.when(F.col("kind") == 1, F.lit(SNAPSHOT.date())).when(F.col("kind") == 4, F.lit(dt.date(1999, 1, 1))).alias("snapshot_day"))


def moved_analyses(m):
    """Analyses moved back 200 days, so that prices follow them; the stated direction as it is read from the model's answer."""
    even = F.col("analysis_id") % 2 == 0
    known = F.col("direction").isin("bullish", "bearish")
    return m.analyses().select(
        "analysis_id", "company_id", "status", F.timestamp_seconds(F.unix_timestamp("completed_at") - 200 * 86400).alias("created_at"),
        F.when(even, F.when(F.col("direction") != "sideways", F.col("direction"))).otherwise(
            F.when(known, F.col("direction")).otherwise("neutral")).alias("llm_direction"),
        "llm_confidence", F.col("source_count").alias("evidence_count"))


def snapshot_folder(m, bars=None, scores=None, companies=None):
    """A stored snapshot of mid 2000, written twice, and an earlier one."""
    path = f"{shared_folder(m.spark)}/snapshots-{uuid.uuid4().hex}"
    for day in (dt.datetime(1998, 12, 31), SNAPSHOT, SNAPSHOT):
        snapshots.write_snapshot(m.bars(until=day) if bars is None else bars, m.scores() if scores is None else scores,
                                 m.companies() if companies is None else companies, F.lit(day), path)
    return path


def stored_runs(m, momentum=False):
    """The queue executed twice into a fresh store; the second pass finds nothing to do."""
    store = rs.run_store(m.spark, f"{shared_folder(m.spark)}/runs-{uuid.uuid4().hex}")
    # trades travel once: snapshots, series, benchmarks and evaluations all read these
    bars = stored(m.bars().select("company_id", "ts", "close", "volume"), "run-bars")
    scores = stored(m.scores(), "run-scores")
    companies = stored(m.companies(), "run-companies")  # of known size, so a small list is broadcast and bars stay
    pinned = snapshots.pinned_prices(snapshots.stored_snapshots(m.spark, snapshot_folder(m, bars, scores, companies)))
    inputs = (specs(m, momentum), bars, companies, scores, moved_analyses(m), pinned)
    rs.execute_queue(store, *inputs)
    if rs.execute_queue(store, *inputs):
        raise RuntimeError("a stored run was executed again")
    return store


@query("backtest_run_store", "K16 N10 F16 F18 F19 J23", with_views("rs_specs rs_perf rs_compare rs_bench rs_trades rs_curve forward ai_eval companies", f"""
    , fin AS (SELECT DISTINCT run_id FROM rs_prices),
    ev AS (SELECT s.run_id, count(*) AS n_scores, count(return_3m) AS n_reached, round(sum(return_1m), 5) AS sum_1m FROM forward f JOIN companies c USING (company_id)
           JOIN rs_specs s ON (s.sector IS NULL OR s.sector = c.sector) AND f.ts BETWEEN lo AND hi JOIN fin USING (run_id) GROUP BY 1),
    ai AS (SELECT s.run_id, count(*) AS n_analyses, count(forward_return) AS n_judged FROM ai_eval a JOIN companies c USING (company_id)
           JOIN rs_specs s ON (s.sector IS NULL OR s.sector = c.sector) AND a.created_at BETWEEN lo AND hi JOIN fin USING (run_id) GROUP BY 1)
    SELECT run_id, CASE WHEN fin.run_id IS NULL THEN 'failed' ELSE 'completed' END AS status,
           CASE WHEN kind = 4 THEN 'Snapshot 1999-01-01 not found' WHEN kind = 5 THEN 'No price data available' END AS error_message,
           CASE WHEN fin.run_id IS NOT NULL THEN CASE WHEN kind = 1 THEN 'pinned' ELSE 'unpinned' END END AS coverage_mode,
           CASE WHEN fin.run_id IS NOT NULL THEN coalesce(b.source, 'none') END AS benchmark_source,
           {sql_rnd(*_PERF, digits=5)}, {sql_rnd(*_CMP, digits=5)}, strategy_return > benchmark_return AS outperformed,
           coalesce(n_trades, 0) AS n_trades, round(coalesce(amount, 0), 2) AS amount, coalesce(n_days, 0) AS n_days, coalesce(n_scores, 0) AS n_scores,
           coalesce(n_reached, 0) AS n_reached, round(coalesce(sum_1m, 0), 3) AS sum_1m, coalesce(n_analyses, 0) AS n_analyses, coalesce(n_judged, 0) AS n_judged
    FROM rs_specs LEFT JOIN fin USING (run_id) LEFT JOIN rs_perf USING (run_id) LEFT JOIN rs_compare USING (run_id)
    LEFT JOIN (SELECT DISTINCT run_id, source FROM rs_bench) b USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) AS n_trades, sum(amount) AS amount FROM rs_trades GROUP BY 1) USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) AS n_days FROM rs_curve GROUP BY 1) USING (run_id) LEFT JOIN ev USING (run_id) LEFT JOIN ai USING (run_id)"""))
def backtest_run_store(m):
    """Every stored table of every run, read back as one row of figures."""
    store = stored_runs(m)
    per_run = lambda t, *aggs: store.read(t).groupBy("run_id").agg(*aggs)
    n = F.count(F.lit(1))
    out = store.read("runs").select("run_id", "status", "error_message", "coverage_mode", "benchmark_source")
    for part in (store.read("results").select("run_id", *rnd(*_PERF, digits=5)),
                 store.read("benchmarks").select("run_id", *rnd(*_CMP, digits=5), "outperformed"),
                 per_run("trades", n.alias("n_trades"), F.sum("amount").alias("amount")), per_run("curves", n.alias("n_days")),
                 per_run("score_evaluations", n.alias("n_scores"), F.count("return_3m").alias("n_reached"), F.sum("return_1m").alias("sum_1m")),
                 per_run("ai_evaluations", n.alias("n_analyses"), F.count("forward_return").alias("n_judged"))):
        out = out.join(part, "run_id", "left")
    zero = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0)).cast(kind)
    return out.select(
        "run_id", "status", "error_message", "coverage_mode", "benchmark_source", *_PERF, *_CMP, "outperformed",
        *[zero(c).alias(c) for c in ("n_trades", "n_days", "n_scores", "n_reached", "n_analyses", "n_judged")],
        F.round(zero("amount", "double"), 2).alias("amount"), F.round(zero("sum_1m", "double"), 3).alias("sum_1m"))


@query("backtest_run_detail", "H19", _with_momentum("""
    , t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, ticker, action) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM all_trades)
    SELECT s.run_id::BIGINT AS run_id, s.kind = 6 OR rs_perf.run_id IS NOT NULL AS has_result, s.kind = 6 OR rs_compare.run_id IS NOT NULL AS has_benchmark,
           round(total_return, 5) AS total_return, round(beta, 5) AS beta, coalesce(any_value(n), 0) > 100 AS has_more, count(t.run_id) AS n_listed,
           coalesce(string_agg(ticker || ' ' || action || ' ' || strftime(ts, '%Y-%m-%d'), ',' ORDER BY k), '') AS trades
    FROM all_runs s LEFT JOIN rs_perf USING (run_id) LEFT JOIN rs_compare USING (run_id) LEFT JOIN t ON t.run_id = s.run_id AND k <= 100 GROUP BY ALL"""))
def backtest_run_detail(m):
    """Each run with result, benchmark, its first hundred trades and whether there are more; figures of the equal-weight runs."""
    d = rs.run_detail(stored_runs(m, momentum=True))
    text = F.array_join(F.transform("trades", lambda t: F.concat_ws(" ", t["ticker"], t["action"], F.date_format(t["ts"], "yyyy-MM-dd"))), ",")
    even = lambda c: F.when(F.col("strategy") == "equal_weight", F.round(c, 5))
    return d.select("run_id", F.col("result").isNotNull().alias("has_result"), F.col("benchmark").isNotNull().alias("has_benchmark"),
                    even("result.total_return").alias("total_return"), even("benchmark.beta").alias("beta"), "has_more",
                    F.size("trades").cast("long").alias("n_listed"), text.alias("trades"))


@query("backtest_trade_page", "H10", _with_momentum(f"""
    SELECT run_id::BIGINT AS run_id, ticker, {sql_day("ts")}, action, n > 75 AS has_more FROM (
      SELECT *, row_number() OVER (ORDER BY ts, ticker, action) AS k, count(*) OVER () AS n FROM all_trades WHERE run_id = 62) WHERE k BETWEEN 51 AND 75"""))
def backtest_trade_page(m):
    """Trades 51 to 75 of a momentum run: the page behind the key of the first fifty."""
    trades = stored_runs(m, momentum=True).read("trades").filter("run_id = 62")
    first = rs.keyset_page(trades, rs.TRADE_ORDER, 50)
    after = first.orderBy(*[F.desc(c) for c in rs.TRADE_ORDER]).first()
    key = {c: after[c] for c in rs.TRADE_ORDER} if after else None
    page = rs.keyset_page(trades, rs.TRADE_ORDER, 25, key)
    return page.select("run_id", "ticker", day_text("ts"), "action", "has_more")


@query("backtest_run_page", "H10", with_views("rs_specs", """
    SELECT run_id, true AS has_more FROM rs_specs WHERE run_id < (SELECT run_id FROM rs_specs ORDER BY run_id DESC LIMIT 1 OFFSET 2) ORDER BY run_id DESC LIMIT 5"""))
def backtest_run_page(m):
    """Newest runs first: the five behind the first three."""
    runs = stored_runs(m).read("runs")
    last = rs.keyset_page(runs, ["run_id"], 3, descending=True).agg(F.min("run_id").alias("run_id")).first().asDict()
    return rs.keyset_page(runs, ["run_id"], 5, last, descending=True).select("run_id", "has_more")


@query("snapshot_store", "B11 B12 A6", with_views("bars companies scores", f"""
    , days AS (SELECT TIMESTAMP '1998-12-31' AS as_of UNION ALL SELECT TIMESTAMP '2000-06-30'),
    p AS (SELECT as_of, ticker, count(*) AS n_bars, round(sum(close), 4) AS closes, max(ts) AS last_ts FROM bars JOIN companies USING (company_id) JOIN days ON ts <= as_of GROUP BY ALL),
    s AS (SELECT as_of, ticker, overall_score FROM scores JOIN companies USING (company_id) JOIN days ON ts <= as_of
          QUALIFY row_number() OVER (PARTITION BY as_of, ticker ORDER BY ts DESC) = 1)
    SELECT strftime(as_of, '%Y-%m-%d') AS day, ticker, n_bars, round(closes, 2) AS closes, strftime(last_ts, '%Y-%m-%d') AS last_ts, overall_score
    FROM p FULL JOIN s USING (as_of, ticker)"""))
def snapshot_store(m):
    """Two stored days, the later written twice, read back from the folder."""
    s = snapshots.stored_snapshots(m.spark, snapshot_folder(m))
    total = F.aggregate("bars", F.lit(0.0), lambda a, b: a + b["close"])
    return s.select(day_text("day"), "ticker", F.size("bars").cast("long").alias("n_bars"), F.round(total, 2).alias("closes"),
                    F.date_format(F.element_at("bars", -1)["ts"], "yyyy-MM-dd").alias("last_ts"), "overall_score")


@query("snapshot_page", "H10 B12", with_views("bars companies", """
    , days AS (SELECT TIMESTAMP '1998-12-31' AS as_of UNION ALL SELECT TIMESTAMP '2000-06-30')
    SELECT strftime(as_of, '%Y-%m-%d') AS day, count(DISTINCT company_id) AS tickers, count(*) AS bars, true AS has_more
    FROM days JOIN bars ON ts <= as_of JOIN companies USING (company_id) WHERE as_of > TIMESTAMP '2000-01-01' GROUP BY 1"""))
def snapshot_page(m):
    """The newest stored snapshot, with a flag that an older one follows."""
    listed = snapshots.snapshot_list(snapshots.stored_snapshots(m.spark, snapshot_folder(m)))
    return rs.keyset_page(listed, ["day"], 1, descending=True).select(day_text("day"), "tickers", F.col("bars").cast("long").alias("bars"), "has_more")


# -- performance of the rebalancing strategies ------------------------------------

add_view("thr_ranked", "ew_prices mom_dates scores companies", """
    SELECT p.run_id, p.ts, p.ticker FROM ew_prices p JOIN mom_dates d ON d.run_id = p.run_id AND d.ts = p.ts
    ASOF JOIN (SELECT ticker, ts AS score_ts, overall_score AS score FROM scores JOIN companies USING (company_id)
               WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-06-30') s ON s.ticker = p.ticker AND p.ts >= score_ts WHERE score >= 65""")
_FOLDED = _sizes[_sizes.index(", bar_at AS"):_sizes.rindex("SELECT run_id::BIGINT")]
_STRATEGY = f"""
    , buys AS (SELECT ep.run_id, ticker, e, d.ts, size / price AS shares, size FROM ep JOIN mom_dates d USING (run_id, k) JOIN fold USING (run_id, k)
             WHERE picked AND price > 0 AND size > 1e-9 AND i > 0),
    held AS (SELECT run_id, ticker, e, sum(size) / sum(shares) AS paid FROM buys GROUP BY ALL),
    ends AS (SELECT run_id, ticker, e, d.ts, price FROM ep JOIN mom_dates d USING (run_id, k) WHERE was AND NOT picked),
    lasts AS (SELECT run_id, ticker, arg_max(close, ts) AS price FROM ew_prices GROUP BY ALL),
    sells AS (SELECT h.*, coalesce(ends.price, lasts.price) AS price FROM held h LEFT JOIN ends USING (run_id, ticker, e) JOIN lasts USING (run_id, ticker)),
    days AS (SELECT DISTINCT run_id, ts FROM ew_prices),
    worth AS (SELECT x.run_id, x.ts, sum(shares * p.close) AS worth FROM (
                SELECT days.run_id, days.ts, b.ticker, b.shares FROM days JOIN buys b ON b.run_id = days.run_id AND days.ts >= b.ts
                LEFT JOIN ends ON ends.run_id = b.run_id AND ends.ticker = b.ticker AND ends.e = b.e WHERE ends.ts IS NULL OR days.ts < ends.ts) x
              ASOF JOIN ew_prices p ON p.run_id = x.run_id AND p.ticker = x.ticker AND x.ts >= p.ts GROUP BY ALL),
    curve AS (SELECT days.run_id, days.ts, 100000.0 + days.run_id * 5000 AS capital, round(coalesce(rest, 100000.0 + days.run_id * 5000) + coalesce(worth, 0), 2) AS value
              FROM days ASOF LEFT JOIN (SELECT run_id, ts, rest FROM fold JOIN mom_dates USING (run_id, k) WHERE i > 0) f ON f.run_id = days.run_id AND days.ts >= f.ts
              LEFT JOIN worth ON worth.run_id = days.run_id AND worth.ts = days.ts),
    perf AS ({VIEWS["ew_perf"][1].replace("ew_curve", "curve")})
    SELECT perf.run_id::BIGINT AS run_id, {sql_rnd(*_PERF, digits=4)}, round(win_rate, 6) AS win_rate, n_buys + n_sells AS total_trades, round(final_capital, 0) AS final_capital
    FROM perf JOIN (SELECT run_id, count(*) AS n_buys FROM buys GROUP BY 1) USING (run_id)
    JOIN (SELECT run_id, count(*) AS n_sells, avg((price > paid)::INT) AS win_rate FROM sells GROUP BY 1) USING (run_id)"""


def strategy_performance(m, prices, picks):
    from tallyvane.catalog.backtests import sector_runs
    from tallyvane.operators import backtest as bt

    runs = sector_runs(m)
    trades, _ = bt.trades_of(runs, prices, bt.rebalance_dates(prices, 21), picks)
    p = bt.performance(runs, bt.equity_curve(runs, prices, trades), trades)
    return p.select("run_id", *rnd(*_PERF, digits=4), *rnd("win_rate"), "total_trades", *rnd("final_capital", digits=0))


@query("momentum_performance", "K13 F16 F17 N10", with_views("mom_ranked ew_prices mom_dates", _FOLDED + _STRATEGY, recursive=True))
def momentum_performance(m):
    """Five best of sixty days, every 21 trading days, per region."""
    from tallyvane.catalog.backtests import sector_prices
    from tallyvane.operators import backtest as bt

    prices = sector_prices(m).withColumns({"lookback": F.lit(60), "top_n": F.lit(5)})
    return strategy_performance(m, prices, bt.momentum_picks(prices, bt.rebalance_dates(prices, 21)))


@query("score_threshold_performance", "K14 F16 F17 N10", with_views("thr_ranked ew_prices mom_dates", _FOLDED.replace("mom_ranked", "thr_ranked") + _STRATEGY, recursive=True))
def score_threshold_performance(m):
    """Everything with a latest score of 65 or more, every 21 trading days, per region."""
    from tallyvane.catalog.backtests import score_history, sector_prices
    from tallyvane.operators import backtest as bt

    prices = sector_prices(m).withColumn("threshold", F.lit(65.0))
    scores = prices.select("run_id", "ticker").distinct().join(score_history(m), "ticker").filter(F.col("score_ts").between(F.lit(START), F.lit(END)))
    return strategy_performance(m, prices, bt.score_picks(prices, bt.rebalance_dates(prices, 21), scores))
