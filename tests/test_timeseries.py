"""As-of joins, forward returns and indicators against hand cases and pandas."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from tallyvane.operators.asof import asof_join
from tallyvane.operators.indicators import technical_indicators
from tallyvane.operators.pricing import forward_returns
from tallyvane.operators.risk import price_risk

DAY0 = dt.datetime(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def bars_of(spark, closes, company=1):
    rows = [(company, day(i), c) for i, c in closes]
    return spark.createDataFrame(rows, "company_id long, ts timestamp, close double")


@pytest.mark.parametrize("closes,expected", [
    ([(0, 100.0), (20, 110.0)], (None, None, None)),
    ([(0, 100.0), (29, 112.0)], (0.12, None, None)),
])
def test_forward_returns_wait_for_the_horizon(spark, closes, expected):
    points = spark.createDataFrame([(1, day(0))], "company_id long, ts timestamp")
    row = forward_returns(points, bars_of(spark, closes), "ts").first()
    got = (row["return_1m"], row["return_3m"], row["return_6m"])
    assert [None if g is None else round(g, 9) for g in got] == list(expected)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("bucket", [None, 86400 * 3])
def test_asof_equals_a_linear_scan(spark, forward, bucket):
    rng = random.Random(5)
    left = [(k, day(rng.randrange(40)), i) for i, k in enumerate(rng.choices([1, 2, 3], k=60))]
    right = sorted({(k, day(rng.randrange(40))) for k in rng.choices([1, 2], k=25)})
    right = [(k, t, float(i)) for i, (k, t) in enumerate(right)]
    out = asof_join(spark.createDataFrame(left, "k long, t timestamp, id int"),
                    spark.createDataFrame(right, "k long, u timestamp, v double"),
                    ["k"], "t", "u", {"v": "v"}, forward=forward, bucket_seconds=bucket)
    got = {r["id"]: r["v"] for r in out.collect()}
    for k, t, i in left:
        hits = [(u, v) for kk, u, v in right if kk == k and (u >= t if forward else u <= t)]
        want = (min(hits)[1] if forward else max(hits)[1]) if hits else None
        assert got[i] == want


def test_indicators_match_pandas(spark):
    rng = np.random.default_rng(3)
    n = 60
    close = pd.Series(100 + rng.normal(0, 1, n).cumsum())
    rows = [(1, day(i), float(c), float(c + 1), float(c - 1), float(c), 0.0 if i % 4 else None, int(10 + i))
            for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "company_id long, ts timestamp, open double, high double, low double, "
                                       "close double, adjusted_close double, volume long")
    got = technical_indicators(bars).first()
    delta = close.diff()
    gain = delta.where(delta > 0, 0).ewm(alpha=1 / 14).mean().iloc[-1]
    loss = (-delta.where(delta < 0, 0)).ewm(alpha=1 / 14).mean().iloc[-1]
    line = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    want = {
        "sma_20": close.tail(20).mean(), "sma_200": None, "ema_20": close.ewm(span=20, adjust=False).mean().iloc[-1],
        "rsi_14": 100 - 100 / (1 + gain / loss), "macd": line.iloc[-1],
        "macd_signal": line.ewm(span=9, adjust=False).mean().iloc[-1],
        "bollinger_upper": close.tail(20).mean() + 2 * close.tail(20).std(),
        "volatility_30d": close.pct_change().tail(30).std() * math.sqrt(252),
        "momentum": (close.iloc[-1] / close.iloc[-11] - 1) * 100,
        "drawdown": abs(((close - close.cummax()) / close.cummax()).min()),
    }
    for name, value in want.items():
        assert got[name] == (None if value is None else pytest.approx(value, rel=1e-9)), name


def test_flat_prices_give_no_rsi_and_no_autocorrelation(spark):
    rows = [(1, day(i), 5.0, 5.0, 5.0, 5.0, None, 1) for i in range(40)]
    bars = spark.createDataFrame(rows, "company_id long, ts timestamp, open double, high double, low double, "
                                       "close double, adjusted_close double, volume long")
    assert technical_indicators(bars).first()["rsi_14"] is None
    risk = price_risk(bars).first()
    assert risk["autocorr"] is None and risk["volatility"] == 0.0


def test_value_at_risk_is_the_linear_percentile(spark):
    rng = np.random.default_rng(9)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 45)))
    rows = [(1, day(i), float(c), 10) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "company_id long, ts timestamp, close double, volume long")
    rets = close[1:] / close[:-1] - 1
    assert price_risk(bars).first()["value_at_risk"] == pytest.approx(np.percentile(rets, 5))


def test_ties_are_inclusive(spark):
    left = spark.createDataFrame([(1, day(3))], "k long, t timestamp")
    right = spark.createDataFrame([(1, day(3), 7.0), (1, day(2), 6.0)], "k long, u timestamp, v double")
    for forward in (False, True):
        assert asof_join(left, right, ["k"], "t", "u", {"v": "v"}, forward).first()["v"] == 7.0


def test_reactions_of_a_hot_company_in_buckets(spark):
    import datetime as dt
    import random

    from tallyvane.operators import pricing

    rng = random.Random(1)
    at = lambda h: dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)
    hot = lambda: 1 if rng.random() < 0.34 else rng.randrange(2, 9)
    events = spark.createDataFrame([(hot(), i, at(rng.randrange(9000))) for i in range(600)], "company_id int, n int, at timestamp")
    bars = spark.createDataFrame([(c, at(24 * d), float(c + d), d) for c in range(1, 8) for d in range(0, 400) if rng.random() < 0.1 * c],
                                 "company_id int, ts timestamp, close double, volume int")
    rows = lambda b: sorted(map(tuple, pricing.with_reaction(events, bars, "at", b).collect()), key=str)
    assert rows(None) == rows(5 * 86400) == rows(pricing.REACTION_BUCKET)
