"""Results at the edges where operators and their SQL parted on larger tables."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tallyvane.catalog.registry import load_all
from tallyvane.functions import numeric
from tallyvane.operators import embedding, portfolio, risk, serving


def test_unknown_scores_are_neutral(spark):
    none = F.lit(None).cast("double")
    got = spark.range(1).select(numeric.bounded_score(none), numeric.bounded_score(F.lit(float("inf"))), numeric.normalize_range(none, 0, 2),
                                numeric.normalize_range(none, 0, 2, invert=True), numeric.bounded_score(F.lit(120.0))).first()
    assert list(got) == [50.0, 50.0, 50.0, 50.0, 100.0]


def test_level_follows_the_stated_age(spark):
    now = dt.datetime(2024, 1, 31)
    beats = spark.createDataFrame([(str(s), now - dt.timedelta(seconds=s)) for s in (5402, 5403, 10802)], "task string, last_success_at timestamp")
    cadence = spark.createDataFrame([("10802", 60)], "task string, interval_minutes int")
    got = {r["task"]: (r["age_minutes"], r["level"]) for r in serving.job_freshness(beats, cadence, F.lit(now)).collect()}
    assert got == {"5402": (90.0, "ok"), "5403": (90.1, "delayed"), "10802": (180.0, "delayed")}


def test_explanations_round_like_exact_decimals(spark):
    rows = spark.createDataFrame([(1, "A", "x", 0.15, 4.25, 0.21), (2, "A", "x", 0.15, 4.35, 0.27)],
                                 "p int, ticker string, sector string, weight double, score double, volatility double").select(
        "*", F.lit(100000.0).alias("capital"), F.lit(1000.0).alias("cash_reserve"))
    s = portfolio.portfolio_summary(rows, ["p"])
    got = {r["p"]: r["explanation"] for r in portfolio.explanations(rows, s.withColumn("weighted_score", F.when(F.col("p") == 1, 4.25).otherwise(4.35)), ["p"]).collect()}
    for p, score, vol in ((1, 4.25, 0.21), (2, 4.35, 0.27)):
        assert f"Portfolio fit score: {score:.1f}/100" in got[p]
        assert f"expected risk: {np.sqrt(0.15 * 0.15 * vol * vol) * 100:.1f}%" in got[p]


def test_every_text_has_length_one():
    encode = embedding.hashing_encoder(1)  # in one dimension any two words of opposite signs cancel out
    words = [w for w in "a b c d e f g h i j k l m n o p q r s t".split()]
    signs = {w: encode([w])[0][0] for w in words}
    plus, minus = (next(w for w in words if signs[w] == v) for v in (1.0, -1.0))
    assert encode([f"{plus} {minus}", "", "  "]) == [[1.0]] * 3


def test_figures_without_enough_returns(spark):
    """The operator leaves them open; the query gives the bounds that its SQL states."""
    days = [(1, dt.datetime(2001, 1, 1) + dt.timedelta(days=i), 100.0 + i % 5, 10) for i in range(24)]
    bars = spark.createDataFrame(days, "company_id long, ts timestamp, close double, volume long").withColumn("adjusted_close", F.col("close"))
    latest = spark.createDataFrame([], "company_id long, total_debt double, shareholders_equity double, net_income double, free_cash_flow double")
    events = spark.createDataFrame([], "company_id long, event_date timestamp, impact string")
    rows = risk.risk_metrics(bars, latest, events, F.lit(dt.datetime(2001, 1, 1)))
    assert rows.select("beta", "correlation_risk").first() == (None, None)
    load_all()
    from tallyvane.catalog.risk import stated

    assert stated(rows).select("beta", "correlation_risk").first() == (0.1, 1.0)
