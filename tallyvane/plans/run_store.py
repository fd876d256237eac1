"""Backtest runs with everything that belongs to them, stored in one commit.

Trades, equity curve, result, benchmark comparison, score and analysis evaluations of
all queued runs and their status rows become visible together. Runs that have a status
row already are left alone, so a second pass over the same queue stores nothing, and
so does a pass after a driver was lost halfway.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvane.operators import backtest as bt
from tallyvane.operators import evaluation
from tallyvane.operators.materialize import stored
from tallyvane.operators.serving import page
from tallyvane.plans import backtests
from tallyvane.sources.store import Store

TABLES = {
    "runs": ("run_id bigint, strategy string, status string, error_message string, start_date timestamp, end_date timestamp, "
             "initial_capital double, benchmark_ticker string, snapshot_day date, benchmark_source string, coverage_mode string, "
             "pinned array<string>, live array<string>"),
    "trades": "run_id bigint, ticker string, ts timestamp, action string, price double, shares double, amount double, kind string",
    "curves": "run_id bigint, ts timestamp, value double",
    "results": ("run_id bigint, total_return double, annualized_return double, volatility double, sharpe_ratio double, max_drawdown double, "
                "win_rate double, total_trades bigint, final_capital double"),
    "benchmarks": ("run_id bigint, benchmark_ticker string, strategy_return double, benchmark_return double, alpha double, beta double, "
                   "tracking_error double, information_ratio double, outperformed boolean"),
    "score_evaluations": ("run_id bigint, ticker string, score_date timestamp, score double, return_1m double, return_3m double, "
                          "return_6m double, actual_outcome string"),
    "ai_evaluations": ("run_id bigint, analysis_id bigint, ticker string, analysis_date timestamp, llm_direction string, "
                       "actual_direction string, direction_accuracy boolean, forward_return double, source_backed boolean"),
}


def run_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES)


def benchmark_points(runs: DataFrame, bars: DataFrame, companies: DataFrame, pinned: DataFrame) -> DataFrame:
    """(run_id, ts, close, source): benchmark prices of each run, from its snapshot where that has two points in the period, else live.

    Fewer than two live points give none. Runs are few: bars and snapshots stay where they are.
    """
    want = runs.select("run_id", F.upper("benchmark_ticker").alias("ticker"), "start_date", "end_date", "snapshot_day")
    inside = F.col("ts").between(F.col("start_date"), F.col("end_date"))
    named = companies.select("company_id", "ticker").join(want, "ticker")
    live = bars.join(F.broadcast(named), "company_id").filter(inside).select("run_id", "ts", "close", F.lit("live").alias("source"))
    fixed = pinned.join(F.broadcast(want), ["snapshot_day", "ticker"]).filter(inside).select("run_id", "ts", "close", F.lit("snapshot").alias("source"))
    both = fixed.unionByName(live)
    enough = both.groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    # 'snapshot' sorts behind 'live'
    chosen = enough.groupBy("run_id").agg(F.max("source").alias("source"))
    return both.join(chosen, ["run_id", "source"], "left_semi")


def in_scope(rows: DataFrame, runs: DataFrame, companies: DataFrame, ts: str) -> DataFrame:
    """Rows (company_id, ...) of each run's sector and period; a run without a sector takes every company."""
    sectors = companies.agg(F.collect_set("sector").alias("all")).scalar()
    scope = runs.select("run_id", "start_date", "end_date", F.explode(
        F.when(F.col("sector").isNull(), sectors).otherwise(F.array("sector"))).alias("sector"))
    named = rows.join(companies.select("company_id", "ticker", "sector"), "company_id")
    return named.join(scope, "sector").filter(F.col(ts).between(F.col("start_date"), F.col("end_date"))).drop("start_date", "end_date", "sector")


def build(queued: DataFrame, bars: DataFrame, companies: DataFrame, scores: DataFrame, analyses: DataFrame, pinned: DataFrame) -> dict[str, DataFrame]:
    """All tables of the queued runs; forward returns are computed once per score and analysis, whatever number of runs reads them."""
    ticker_scores = scores.join(companies.select("company_id", "ticker"), "company_id").select(
        "ticker", F.col("ts").alias("score_ts"), F.col("overall_score").alias("score"), F.col("risk_score").alias("risk"))
    known = pinned.select("snapshot_day").distinct()
    missing = queued.filter("snapshot_day IS NOT NULL").join(known, "snapshot_day", "left_anti").select(
        "run_id", F.concat(F.lit("Snapshot "), F.col("snapshot_day").cast("string"), F.lit(" not found")).alias("_lost"))
    result = backtests.execute(queued, bars, companies, ticker_scores, pinned)
    done = result.status.filter("status = 'completed'").select("run_id")
    active = queued.join(done, "run_id", "left_semi")
    points = stored(benchmark_points(active, bars, companies, pinned), "benchmark-points")
    compared = bt.benchmark_comparison(result.curve, points.select("run_id", "ts", "close"))
    source = active.select("run_id", "strategy", F.col("snapshot_day").alias("snapshot_id")).join(
        points.select("run_id", "source").distinct(), "run_id", "left").withColumn("benchmark_source", F.coalesce("source", F.lit("none")))
    coverage = bt.coverage(source).join(source.select("run_id", "benchmark_source"), "run_id")
    status = (queued.drop("status").join(result.status.drop("strategy"), "run_id").join(missing, "run_id", "left").join(coverage, "run_id", "left")
              .withColumn("error_message", F.coalesce("_lost", "error_message")).withColumnRenamed("mode", "coverage_mode"))
    judged = evaluation.evaluate_scores(scores, bars).withColumnRenamed("ts", "score_date").withColumnRenamed("overall_score", "score")
    said = evaluation.evaluate_analyses(analyses, bars).withColumnRenamed("created_at", "analysis_date")
    return {
        "trades": result.trades, "curves": result.curve, "results": result.performance,
        "benchmarks": compared.join(queued.select("run_id", F.upper("benchmark_ticker").alias("benchmark_ticker")), "run_id"),
        "score_evaluations": in_scope(judged, active, companies, "score_date"),
        "ai_evaluations": in_scope(said, active, companies, "analysis_date"),
        "runs": status,
    }


def execute_queue(store: Store, specs: DataFrame, bars: DataFrame, companies: DataFrame, scores: DataFrame, analyses: DataFrame,
                  pinned: DataFrame) -> dict[str, int]:
    """Run and store every queued specification that has no status row yet; returns the rows written per table.

    ``specs`` as for ``backtests.execute``, with benchmark_ticker and snapshot_day; ``pinned`` as from ``snapshots.pinned_prices``.
    """
    waiting = stored(specs.filter("status = 'queued'").join(store.read("runs").select("run_id"), "run_id", "left_anti"), "queued-runs")
    if waiting.isEmpty():
        return {}
    return store.commit(f"runs-{uuid.uuid4().hex}", "backtests", lambda: build(waiting, bars, companies, scores, analyses, pinned))


TRADE_ORDER = ["ts", "ticker", "action"]


def run_detail(store: Store, listed: int = 100) -> DataFrame:
    """One row per run: its status row, result and benchmark (null where there is none), its first trades and whether there are more.

    A window keeps one trade more than the page per run, before anything is collected; a run's list is never longer.
    """
    w = Window.partitionBy("run_id").orderBy(*TRADE_ORDER)
    ahead = store.read("trades").drop("commit").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= listed + 1)
    nested = ahead.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(
        "_n", "ts", "ticker", "action", "price", "shares", "amount"))).alias("_t"))
    trades = nested.select("run_id", F.slice("_t", 1, listed).alias("trades"), (F.size("_t") > listed).alias("has_more"))
    pack = lambda t: store.read(t).select("run_id", F.struct(*[c for c in store.read(t).columns if c not in ("run_id", "commit")]).alias(t[:-1]))
    return (store.read("runs").drop("commit").join(pack("results"), "run_id", "left").join(pack("benchmarks"), "run_id", "left")
            .join(trades, "run_id", "left").withColumn("has_more", F.coalesce("has_more", F.lit(False)))
            .withColumn("trades", F.coalesce("trades", F.array().cast(trades.schema["trades"].dataType))))


def keyset_page(rows: DataFrame, order: list[str], limit: int, after: dict | None = None, descending: bool = False) -> DataFrame:
    """The rows behind the key ``after`` in order of the columns, at most ``limit``, with ``has_more``.

    The last row of a page is the next page's ``after``; the order's columns must be unique together and not null. One row beyond the page is taken in the same ordered
    take to know whether there are more, so neither the rows before nor a count are touched.
    """
    if after is not None:
        reached = F.lit(False)
        for i, c in enumerate(order):
            same = F.lit(True)
            for d in order[:i]:
                same = same & (F.col(d) == F.lit(after[d]))
            step = F.col(c) < F.lit(after[c]) if descending else F.col(c) > F.lit(after[c])
            reached = reached | (same & step)
        rows = rows.filter(reached)
    turn = F.desc if descending else F.asc
    return page(rows, [turn(c) for c in order], limit)


def pages(rows: DataFrame, order: list[str], limit: int, descending: bool = False):
    """All pages one after another, as lists of rows; for readers that follow the keys."""
    after = None
    while True:
        found = keyset_page(rows, order, limit, after, descending).collect()
        if found:
            yield found
        if not found or not found[0]["has_more"]:
            return
        last = max if not descending else min
        after = dict(zip(order, last(tuple(r[c] for c in order) for r in found)))
