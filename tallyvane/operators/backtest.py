"""Rebalancing backtests of many runs without walking through days in Python.

Every rebalance date k splits the cash evenly over the qualifying tickers Q_k, so
each bought position has the same size p_k. A position bought at b and sold at k
returns p_b * price_k / price_b. Hence the cash before buying at k is linear in the
earlier sizes:

    cash_k = rest_{k-1} + sum_b p_b * A[b, k],   A[b, k] = sum_sold price_k / price_b

Spark computes A from episodes (all joins and sums, spread over tickers); the only
sequential part is a fold over the rebalance dates of each run, a calendar-bounded
list, done with ``aggregate``. Trades and daily values are then joins and sums again:
the equity curve is a running sum of per-bar value changes, never a dates x holdings
grid.

Inputs: ``runs`` (run_id, initial_capital), ``prices`` (run_id, ticker, ts, close),
``dates`` (run_id, ts, k) and ``picks`` (run_id, ts, ticker) of qualifying tickers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.operators.materialize import materialize

DUST = 1e-9


def rebalance_dates(prices: DataFrame, every) -> DataFrame:
    """Every n-th date of each run's own calendar (n a number or a per-run column)."""
    keys = ["run_id", *([every] if isinstance(every, str) else [])]
    days = prices.select(*keys, "ts").distinct()
    w = Window.partitionBy("run_id").orderBy("ts")
    step = F.col(every) if isinstance(every, str) else F.lit(every)
    pos = days.withColumn("pos", F.row_number().over(w) - 1)
    return pos.filter(F.col("pos") % step == 0).select(
        "run_id", "ts", (F.col("pos") / step).cast("int").alias("k"))


def _episodes(prices: DataFrame, dates: DataFrame, picks: DataFrame) -> DataFrame:
    """(run, ticker, k, price, picked, episode) on rebalance dates where the ticker has a bar.

    An episode is a streak of picks; the first unpicked date after it is its sale.
    """
    at = prices.join(dates, ["run_id", "ts"]).select("run_id", "ticker", "ts", "k", F.col("close").alias("price"))
    chosen = picks.select("run_id", "ts", "ticker", F.lit(1).alias("picked"))
    at = at.join(chosen, ["run_id", "ts", "ticker"], "left").withColumn("picked", F.coalesce("picked", F.lit(0)))
    w = Window.partitionBy("run_id", "ticker").orderBy("k")
    was = F.coalesce(F.lag("picked").over(w), F.lit(0))
    at = at.withColumn("_start", ((F.col("picked") == 1) & (was == 0)).cast("int"))
    at = at.withColumn("sale", (F.col("picked") == 0) & (was == 1))
    at = at.withColumn("episode", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.filter("picked = 1 OR sale").drop("_start")


def _growth(episodes: DataFrame) -> DataFrame:
    """A[b, k] per run: growth of one currency unit bought at b and sold at k, summed over tickers."""
    buys = episodes.filter("picked = 1 AND price > 0").select(
        "run_id", "ticker", "episode", F.col("k").alias("b"), F.col("price").alias("paid"))
    sales = episodes.filter("sale").select("run_id", "ticker", "episode", "k", "price")
    return (buys.join(sales, ["run_id", "ticker", "episode"])
            .groupBy("run_id", "k", "b").agg(F.sum(F.col("price") / F.col("paid")).alias("g")))


def position_sizes(runs: DataFrame, episodes: DataFrame) -> DataFrame:
    """(run_id, k, size, rest): cash per position and cash left after each rebalance.

    One small row list per run: at most (dates x dates) sums, folded in order.
    """
    n = episodes.filter("picked = 1").groupBy("run_id", "k").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("price") > 0, 1)).alias("n_buy"))
    growth = _growth(episodes).groupBy("run_id", "k").agg(
        F.sort_array(F.collect_list(F.struct("b", "g"))).alias("g"))
    steps = n.join(growth, ["run_id", "k"], "full").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(
        "k", F.coalesce("n", F.lit(0)).cast("double").alias("n"),
        F.coalesce("n_buy", F.lit(0)).cast("double").alias("n_buy"), "g"))).alias("steps"))
    start = F.struct(
        F.col("initial_capital").alias("rest"),
        F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")).alias("size"),
        F.array().cast("array<struct<k:int,size:double,rest:double>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        returned = F.coalesce(F.aggregate(
            s["g"], F.lit(0.0),
            lambda t, e: t + e["g"] * F.coalesce(F.try_element_at(acc["size"], e["b"]), F.lit(0.0))), F.lit(0.0))
        cash = acc["rest"] + returned
        size = F.when((s["n"] > 0) & (cash > DUST), cash / s["n"]).otherwise(0.0)
        rest = cash - size * s["n_buy"]
        return F.struct(
            rest.alias("rest"), F.map_concat(acc["size"], F.create_map(s["k"], size)).alias("size"),
            F.concat(acc["out"], F.array(F.struct(s["k"].alias("k"), size.alias("size"), rest.alias("rest")))).alias("out"))

    folded = runs.join(steps, "run_id", "left").select(
        "run_id", F.explode(F.aggregate(F.coalesce("steps", F.array().cast(
            "array<struct<k:int,n:double,n_buy:double,g:array<struct<b:int,g:double>>>>")), start, step, lambda a: a["out"])).alias("o"))
    return folded.select("run_id", "o.k", "o.size", "o.rest")


def last_bars(prices: DataFrame) -> DataFrame:
    return prices.groupBy("run_id", "ticker").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("price"))


def trades_of(runs: DataFrame, prices: DataFrame, dates: DataFrame, picks: DataFrame,
              last: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(trades, sizes). Open positions are sold at each ticker's own last bar.

    With ``last`` (run_id, ticker, ts, price) ``prices`` may be cut to the dates.
    """
    # both are read several times below
    ep = materialize(_episodes(prices, dates, picks))
    sizes = materialize(position_sizes(runs, ep))
    buys = ep.filter("picked = 1 AND price > 0").join(sizes, ["run_id", "k"]).filter(F.col("size") > DUST).select(
        "run_id", "ticker", "ts", "k", "episode", F.lit("BUY").alias("action"), "price",
        (F.col("size") / F.col("price")).alias("shares"), F.col("size").alias("amount"))
    held = buys.groupBy("run_id", "ticker", "episode").agg(F.sum("shares").alias("shares"))
    sold = ep.filter("sale").join(held, ["run_id", "ticker", "episode"]).select(
        "run_id", "ticker", "ts", "k", "episode", F.lit("SELL").alias("action"), "price", "shares",
        (F.col("shares") * F.col("price")).alias("amount"))
    last = last_bars(prices) if last is None else last
    open_ = held.join(ep.filter("sale").select("run_id", "ticker", "episode"), ["run_id", "ticker", "episode"], "left_anti")
    closing = open_.join(last, ["run_id", "ticker"]).select(
        "run_id", "ticker", "ts", F.lit(None).cast("int").alias("k"), "episode", F.lit("SELL").alias("action"), "price",
        "shares", (F.col("shares") * F.col("price")).alias("amount"))
    trades = (buys.withColumn("kind", F.lit("rebalance")).unionByName(sold.withColumn("kind", F.lit("rebalance")))
              .unionByName(closing.withColumn("kind", F.lit("end"))))
    return materialize(trades), sizes


def equity_curve(runs: DataFrame, prices: DataFrame, trades: DataFrame) -> DataFrame:
    """(run_id, ts, value): cash plus holdings at the last seen price, rounded to cents.

    A holding changes only at its own bars, so the value of all holdings is the
    running sum of (shares x close) differences per bar.
    """
    flow = trades.filter("kind = 'rebalance'")
    sign = F.when(F.col("action") == "BUY", 1.0).otherwise(-1.0)
    moves = flow.groupBy("run_id", "ticker", "ts").agg(F.sum(sign * F.col("shares")).alias("dshares"))
    by_ticker = Window.partitionBy("run_id", "ticker").orderBy("ts")
    held = (prices.join(moves.select("run_id", "ticker").distinct(), ["run_id", "ticker"], "left_semi")
            .join(moves, ["run_id", "ticker", "ts"], "left")
            .withColumn("shares", F.sum(F.coalesce("dshares", F.lit(0.0))).over(
                by_ticker.rowsBetween(Window.unboundedPreceding, 0))))
    worth = F.when(F.abs("shares") > DUST, F.col("shares") * F.col("close")).otherwise(0.0)
    held = held.withColumn("worth", worth).withColumn(
        "change", F.col("worth") - F.coalesce(F.lag("worth").over(by_ticker), F.lit(0.0)))
    by_day = held.groupBy("run_id", "ts").agg(F.sum("change").alias("change"))
    return _summed(runs, prices.select("run_id", "ts").distinct(), by_day, flow, sign)


def _summed(runs: DataFrame, days: DataFrame, by_day: DataFrame, flow: DataFrame, sign: Column) -> DataFrame:
    """Capital plus the running sum of value changes and cash flows over the days of each run."""
    cash = flow.groupBy("run_id", "ts").agg(F.sum(-sign * F.col("amount")).alias("cash"))
    w = Window.partitionBy("run_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = (days.join(by_day, ["run_id", "ts"], "left").join(cash, ["run_id", "ts"], "left")
           .withColumn("_d", F.coalesce("change", F.lit(0.0)) + F.coalesce("cash", F.lit(0.0)))
           .withColumn("_v", F.sum("_d").over(w)))
    return out.join(runs.select("run_id", "initial_capital"), "run_id").select(
        "run_id", "ts", F.round(F.col("initial_capital") + F.col("_v"), 2).alias("value"))


def series_equity_curve(runs: DataFrame, days: DataFrame, scope: DataFrame, series: DataFrame, trades: DataFrame) -> DataFrame:
    """``equity_curve`` without a row per run and bar: bars meet only the positions that are held over them.

    A position is constant from one of its trades to the next. Joined by ticker with the bars of that stretch it gives
    the value changes, which are summed per day before they are shuffled. ``series`` as from ``plans.backtests.series_of``,
    ``scope``: run_id, series, end_date.
    """
    flow = trades.filter("kind = 'rebalance'")
    sign = F.when(F.col("action") == "BUY", 1.0).otherwise(-1.0)
    moves = flow.groupBy("run_id", "ticker", "ts").agg(F.sum(sign * F.col("shares")).alias("d"))
    w = Window.partitionBy("run_id", "ticker").orderBy("ts")
    kept = F.when(F.abs("_sum") > DUST, F.col("_sum")).otherwise(0.0)
    held = moves.withColumn("_sum", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("shares", kept)
    held = held.select("run_id", "ticker", F.col("ts").alias("since"), F.lead("ts").over(w).alias("until"), "shares",
                       F.coalesce(F.lag("shares").over(w), F.lit(0.0)).alias("before"))
    held = held.filter("shares <> 0 OR before <> 0").join(F.broadcast(scope.select("run_id", "series", "end_date").distinct()), "run_id")
    # a stretch without shares counts on its first day only
    stop = F.coalesce("until", F.col("end_date") + F.expr("INTERVAL 1 SECOND"))
    held = held.withColumn("stop", F.when(F.col("shares") == 0, F.col("since") + F.expr("INTERVAL 1 SECOND")).otherwise(stop))
    at = F.when(F.col("ts") == F.col("since"), F.col("before")).otherwise(F.col("shares"))
    rows = series.select("series", "ticker", "ts", "close", "prev_close").join(held, ["series", "ticker"]).filter(
        (F.col("ts") >= F.col("since")) & (F.col("ts") < F.col("stop")))
    change = F.col("shares") * F.col("close") - F.when(at == 0, 0.0).otherwise(at * F.col("prev_close"))
    by_day = rows.groupBy("run_id", "ts").agg(F.sum(change).alias("change"))
    return _summed(runs, days, by_day, flow, sign)


# -- signals --------------------------------------------------------------------

def equal_weight_picks(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dates, picks): everything with a bar on the first date, bought once and held."""
    first = prices.groupBy("run_id").agg(F.min("ts").alias("ts"))
    dates = first.withColumn("k", F.lit(0))
    return dates, prices.join(first, ["run_id", "ts"]).select("run_id", "ts", "ticker")


def momentum_picks(prices: DataFrame, dates: DataFrame, lookback: str = "lookback", top_n: str = "top_n") -> DataFrame:
    """Top-n tickers by positional momentum per rebalance date (ties by ticker).

    ``prices`` carries the per-run parameters as columns.
    """
    w = Window.partitionBy("run_id", "ticker").orderBy("ts")
    rows = prices.withColumn("_i", F.row_number().over(w))
    past = rows.select("run_id", "ticker", (F.col("_i") + F.col(lookback)).alias("_i"), F.col("close").alias("_past"))
    now = rows.join(dates.select("run_id", "ts"), ["run_id", "ts"])
    scored = now.join(past, ["run_id", "ticker", "_i"]).filter(F.col("_past") > 0).withColumn(
        "momentum", (F.col("close") - F.col("_past")) / F.col("_past"))
    by_date = Window.partitionBy("run_id", "ts").orderBy(F.desc("momentum"), "ticker")
    return scored.withColumn("rank", F.row_number().over(by_date)).filter(F.col("rank") <= F.col(top_n)).select(
        "run_id", "ts", "ticker", "momentum", "rank")


def series_momentum_picks(at: DataFrame, series: DataFrame) -> DataFrame:
    """``momentum_picks`` from bars on the dates (``at``, with their count ``i`` and the run's parameters) and the series behind them."""
    past = series.select("series", "ticker", F.col("i").alias("_i"), F.col("ts").alias("_ts"), F.col("close").alias("_past"))
    scored = at.withColumn("_i", F.col("i") - F.col("lookback")).join(past, ["series", "ticker", "_i"]).filter(
        (F.col("_past") > 0) & (F.col("_ts") >= F.col("start_date"))).withColumn("momentum", (F.col("close") - F.col("_past")) / F.col("_past"))
    by_date = Window.partitionBy("run_id", "ts").orderBy(F.desc("momentum"), "ticker")
    return scored.withColumn("rank", F.row_number().over(by_date)).filter(F.col("rank") <= F.col("top_n")).select(
        "run_id", "ts", "ticker", "momentum", "rank")


def score_picks(prices: DataFrame, dates: DataFrame, scores: DataFrame, threshold: str = "threshold") -> DataFrame:
    """Tickers whose latest score at or before the rebalance date reaches the run's threshold.

    ``scores``: run_id, ticker, score_ts, score within the run's period.
    """
    from tallyvane.operators.asof import asof_join

    at = prices.join(dates.select("run_id", "ts"), ["run_id", "ts"])
    joined = asof_join(at, scores, ["run_id", "ticker"], "ts", "score_ts", {"score": "score"})
    return joined.filter(F.col("score") >= F.col(threshold)).select("run_id", "ts", "ticker", "score")


# -- optimiser strategy: sizes depend on state in a non-linear way ----------------

def optimizer_targets(prices: DataFrame, dates: DataFrame, scores: DataFrame, companies: DataFrame) -> DataFrame:
    """Target weights per (run, k, ticker) from the latest scores and caps of the run."""
    from tallyvane.operators.asof import asof_join
    from tallyvane.operators.portfolio import target_weights

    at = prices.join(dates, ["run_id", "ts"])
    rows = asof_join(at, scores, ["run_id", "ticker"], "ts", "score_ts", {"_s": "score", "_r": "risk"})
    or50 = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(50.0))
    opp = rows.join(companies.select("ticker", "sector"), "ticker", "left").select(
        "run_id", "ts", "k", "ticker", F.lit(0).alias("seq"), "close", or50("_s").alias("score"), or50("_r").alias("risk_score"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"), "risk_profile", "max_position_weight", "max_sector_weight")
    return target_weights(opp, ["run_id", "k"]).select("run_id", "ts", "k", "ticker", F.col("close").alias("price"), "weight")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def optimizer_trades(runs: DataFrame, targets: DataFrame, min_trade: float = 100.0) -> DataFrame:
    """Order-dependent rebalancing per run: skip small changes, buy only what cash covers.

    The orders of a date are one short list, exits first, then targets by weight. All
    holdings of a date are priced at once, so only cash runs through its list and only
    the holdings run from date to date; both are folds inside Spark. A position is
    needed again only on the next date its ticker trades, and weights above 0.001 sum
    to at most 1, so a date has under 2000 orders whatever the universe.
    """
    w = Window.partitionBy("run_id", "ticker").orderBy("k")
    kept = targets.withColumn("target", F.col("weight") > 0.001).withColumn(
        "_after", F.coalesce(F.lag("target").over(w), F.lit(False))).filter("target OR _after")
    order = F.struct(F.col("target").alias("stays"), F.when(F.col("target"), -F.col("weight")).alias("rank"), "ticker", "price",
                     F.when(F.col("target"), F.col("weight")).alias("weight"))
    days = kept.groupBy("run_id", "k").agg(F.min("ts").alias("ts"), F.array_sort(F.collect_list(order)).alias("orders"))
    tapes = days.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("k", "ts", "orders"))).alias("days"))
    fill = "struct<ticker:string,price:double,moved:double,left:double>"
    start = F.struct(F.col("initial_capital").cast("double").alias("cash"), F.create_map().cast("map<string,double>").alias("held"),
                     F.array().cast(f"array<struct<k:int,ts:timestamp,fills:array<{fill}>>>").alias("out"))

    def moved(o: Column, capital: Column, cash: Column) -> Column:
        """Shares bought (above 0) or sold (below 0) by one order."""
        gap = o["weight"] * capital - o["have"] * o["price"]
        return (F.when(~o["stays"], -o["have"]).when((o["price"] <= 0) | (F.abs(gap) < min_trade), 0.0)
                .when(gap > 0, F.when(gap <= cash, gap / o["price"]).otherwise(0.0)).otherwise(-F.least(o["have"], -gap / o["price"])))

    def day_fills(priced: Column, cash: Column, capital: Column) -> Column:
        """(cash, fills) after the orders of a date."""
        def one(state: Column, o: Column) -> Column:
            def settled(q: Column) -> Column:
                left = o["have"] + q
                left = F.when((q < 0) & (left <= 0.001), 0.0).otherwise(left)
                return F.struct((state["cash"] - q * o["price"]).alias("cash"), F.concat(state["fills"], F.array(F.struct(
                    o["ticker"].alias("ticker"), o["price"].alias("price"), q.alias("moved"), left.alias("left")))).alias("fills"))

            return _bound(moved(o, capital, state["cash"]), settled)

        return F.aggregate(priced, F.struct(cash.alias("cash"), F.array().cast(f"array<{fill}>").alias("fills")), one)

    def day(acc: Column, d: Column) -> Column:
        priced = F.transform(d["orders"], lambda o: F.struct(
            o["stays"].alias("stays"), o["ticker"].alias("ticker"), o["price"].cast("double").alias("price"), o["weight"].alias("weight"),
            F.coalesce(F.try_element_at(acc["held"], o["ticker"]), F.lit(0.0)).alias("have")))

        def valued(rows: Column) -> Column:
            return _bound(F.aggregate(rows, acc["cash"], lambda v, o: v + o["have"] * o["price"]),
                          lambda capital: day_fills(rows, acc["cash"], capital))

        def carried(done: Column) -> Column:
            fresh = F.map_from_entries(F.transform(F.filter(done["fills"], lambda f: f["left"] > 0),
                                                   lambda f: F.struct(f["ticker"], f["left"])))
            names = F.transform(done["fills"], lambda f: f["ticker"])
            rest = F.map_filter(acc["held"], lambda t, _: ~F.array_contains(names, t))
            real = F.filter(done["fills"], lambda f: f["moved"] != 0)
            return F.struct(done["cash"].alias("cash"), F.map_concat(rest, fresh).alias("held"), F.concat(acc["out"], F.array(
                F.struct(d["k"].alias("k"), d["ts"].alias("ts"), real.alias("fills")))).alias("out"))

        return _bound(_bound(priced, valued), carried)

    folded = tapes.join(runs.select("run_id", "initial_capital"), "run_id").select(
        "run_id", F.explode(F.aggregate("days", start, day, lambda a: a["out"])).alias("d"))
    fills = folded.select("run_id", "d.k", "d.ts", F.explode("d.fills").alias("f"))
    shares = F.abs("f.moved")
    return fills.select("run_id", "f.ticker", "ts", "k", F.when(F.col("f.moved") > 0, "BUY").otherwise("SELL").alias("action"), "f.price",
                        shares.alias("shares"), (shares * F.col("f.price")).alias("amount"), F.lit("rebalance").alias("kind"))


def close_out(trades: DataFrame, prices: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
    """Adds the final sale of every open position at the ticker's own last bar."""
    sign = F.when(F.col("action") == "BUY", 1.0).otherwise(-1.0)
    open_ = trades.groupBy("run_id", "ticker").agg(F.sum(sign * F.col("shares")).alias("shares")).filter("shares > 0.001")
    last = last_bars(prices) if last is None else last
    end = open_.join(last, ["run_id", "ticker"]).select(
        "run_id", "ticker", "ts", F.lit(None).cast("int").alias("k"), F.lit("SELL").alias("action"), "price", "shares",
        (F.col("shares") * F.col("price")).alias("amount"), F.lit("end").alias("kind"))
    return trades.select(end.columns).unionByName(end)


# -- measures -------------------------------------------------------------------

def performance(runs: DataFrame, curve: DataFrame, trades: DataFrame) -> DataFrame:
    """Return, volatility, Sharpe, drawdown and win rate per run."""
    w = Window.partitionBy("run_id").orderBy("ts")
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumn("ret", F.try_divide(F.col("value"), F.lag("value").over(w)) - 1).withColumn(
        "dd", F.try_divide(F.col("value") - peak, peak))
    g = rows.groupBy("run_id").agg(
        F.max_by("value", "ts").alias("final_capital"), F.count(F.lit(1)).alias("n_days"),
        F.count("ret").alias("n_ret"), F.stddev_samp("ret").alias("sd"), F.avg("ret").alias("mean"),
        F.abs(F.min("dd")).alias("max_drawdown"))
    counts = trades.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_trades"))
    out = (runs.join(g, "run_id", "left").join(counts, "run_id", "left").join(win_rates(trades), "run_id", "left"))
    start = F.col("initial_capital")
    final = F.coalesce("final_capital", start)
    vol = F.when(F.col("n_ret") >= 2, F.col("sd") * F.sqrt(F.lit(252.0))).otherwise(0.0)
    out = out.withColumn("volatility", vol)
    return out.select(
        "run_id", ((final - start) / start).alias("total_return"),
        F.when(F.col("n_days") > 1, F.pow(final / start, 252 / F.col("n_days")) - 1).otherwise(0.0).alias("annualized_return"),
        "volatility",
        F.when(F.col("volatility") > 0, F.col("mean") * 252 / F.col("volatility")).otherwise(0.0).alias("sharpe_ratio"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), "win_rate",
        F.coalesce("total_trades", F.lit(0)).alias("total_trades"), F.round(final, 2).alias("final_capital"))


def win_rates(trades: DataFrame) -> DataFrame:
    """Share of sells above the average cost of the position (breakeven is no win).

    A ticker's trades of one run are a short ordered list (two per rebalance date
    at most), folded with (quantity, cost) as the state.
    """
    order = F.struct(F.col("ts"), (F.col("kind") == "end").cast("int").alias("e"),
                     (F.col("action") == "BUY").cast("int").alias("b"), "price", "shares")
    lists = trades.groupBy("run_id", "ticker").agg(F.array_sort(F.collect_list(order)).alias("t"))
    zero = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("c"), F.lit(0).alias("wins"), F.lit(0).alias("closed"))

    def step(a: Column, t: Column) -> Column:
        sells = (t["b"] == 0) & (a["q"] > 0)
        left = a["q"] - F.least(t["shares"], a["q"])
        avg = F.try_divide(a["c"], a["q"])
        return F.when(t["b"] == 1, F.struct(
            (a["q"] + t["shares"]).alias("q"), (a["c"] + t["shares"] * t["price"]).alias("c"), a["wins"].alias("wins"),
            a["closed"].alias("closed"))).when(sells, F.struct(
                left.alias("q"), (left * avg).alias("c"), (a["wins"] + (t["price"] > avg).cast("int")).alias("wins"),
                (a["closed"] + 1).alias("closed"))).otherwise(a)

    folded = lists.select("run_id", F.aggregate("t", zero, step).alias("r"))
    return folded.groupBy("run_id").agg(
        F.try_divide(F.sum("r.wins"), F.sum("r.closed")).alias("win_rate"))


def benchmark_comparison(curve: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Alpha, beta, tracking error (population deviation) and information ratio per run.

    ``benchmark``: run_id, ts, close over the run's period.
    """
    w = Window.partitionBy("run_id").orderBy("ts")

    def returns(df, c, name):
        return df.withColumn(name, F.try_divide(F.col(c), F.lag(c).over(w)) - 1).select("run_id", "ts", name)

    ends = lambda df, c, n: df.groupBy("run_id").agg(
        F.coalesce(F.try_divide(F.max_by(c, "ts") - F.min_by(c, "ts"), F.min_by(c, "ts")), F.lit(0.0)).alias(n),
        F.count(F.lit(1)).alias(f"_n_{n}"))
    both = returns(curve, "value", "s").join(returns(benchmark, "close", "b"), ["run_id", "ts"]).filter(
        "s IS NOT NULL AND b IS NOT NULL").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp("s", "b").alias("cov"), F.var_samp("b").alias("var"),
        (F.stddev_pop(F.col("s") - F.col("b")) * F.sqrt(F.lit(252.0))).alias("te"), F.avg(F.col("s") - F.col("b")).alias("md"))
    out = ends(curve, "value", "strategy_return").join(ends(benchmark, "close", "benchmark_return"), "run_id").filter(
        "_n_benchmark_return >= 2").join(both, "run_id", "left")
    ok = F.col("n") >= 2
    te = F.when(ok, F.col("te"))
    return out.select(
        "run_id", "strategy_return", "benchmark_return",
        (F.col("strategy_return") - F.col("benchmark_return")).alias("alpha"),
        F.when(ok & (F.col("var") > 0), F.col("cov") / F.col("var")).alias("beta"), te.alias("tracking_error"),
        F.when(te > 0, F.col("md") * 252 / te).alias("information_ratio"),
        (F.col("strategy_return") > F.col("benchmark_return")).alias("outperformed"))


def gain_since_start(runs: DataFrame, curve: DataFrame) -> DataFrame:
    """value / initial - 1 at each equity point."""
    return curve.join(runs.select("run_id", "initial_capital"), "run_id").select(
        "run_id", "ts", (F.col("value") / F.col("initial_capital") - 1).alias("gain"))


def coverage(runs: DataFrame) -> DataFrame:
    """Which decision inputs of a run are pinned to its snapshot and which are read live.

    ``runs``: run_id, strategy, snapshot_id, benchmark_source (snapshot / live / none).
    """
    scored = F.col("strategy").isin("score_threshold", "portfolio_optimizer")
    pinned_run = F.col("snapshot_id").isNotNull()
    src = F.col("benchmark_source")
    pinned = F.array_compact(F.array(F.when(pinned_run, F.lit("prices")),
                                     F.when(pinned_run & (src == "snapshot"), F.lit("benchmark"))))
    live = F.array_compact(F.array(
        F.when(~pinned_run, F.lit("prices")), F.when(~pinned_run, F.lit("benchmark")),
        F.when(scored, F.lit("score_history")), F.when(pinned_run & (src == "live"), F.lit("benchmark"))))
    return runs.select(
        "run_id", F.when(~pinned_run, "unpinned").when(F.size(live) > 0, "partially_pinned").otherwise("pinned").alias("mode"),
        pinned.alias("pinned"), live.alias("live"))
