"""Text, evidence, validation, retrieval and portfolio rules on hand cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyvane.functions import ids, times
from tallyvane.functions import text as tx
from tallyvane.operators import embedding, evidence, fundamentals, portfolio, retrieval, upsert, validation


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,want", [("NASDAQ:AAPL", "AAPL"), ("AAPL.US", "AAPL"), ("aapl", "AAPL"), (" AAPL ", "AAPL")])
def test_ticker_forms(spark, raw, want):
    assert value(spark, ids.normalize_ticker(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [(" abc ", "ABC"), ("candidate-12345", "candidate-12345"), ("ABCDEF", "ABCDEF")])
def test_default_identifier(spark, raw, want):
    assert value(spark, ids.normalizer_chain(F.lit(raw), [])) == want


def test_normalizer_chain_runs_last_registered_first(spark):
    chain = [lambda c: F.concat(c, F.lit("1")), lambda c: F.concat(c, F.lit("2"))]
    assert value(spark, ids.normalizer_chain(F.lit(" x "), chain)) == "x21"


@pytest.mark.parametrize("raw,want", [
    ("2026-08-17", dt.datetime(2026, 8, 17)), ("2026-08-17T10:00:00Z", dt.datetime(2026, 8, 17, 10)),
    ("2026-08-17T10:00:00+02:00", dt.datetime(2026, 8, 17, 8)), ("1700000000", dt.datetime(2023, 11, 14, 22, 13, 20)),
    ("1700000000000", dt.datetime(2023, 11, 14, 22, 13, 20)), ("soon", None), ("", None)])
def test_timestamps(spark, raw, want):
    assert value(spark, F.date_format(times.parse_timestamp(F.lit(raw)), "yyyy-MM-dd HH:mm:ss")) == (
        None if want is None else want.strftime("%Y-%m-%d %H:%M:%S"))


def test_word_counts_count_each_word_once(spark):
    text = "Strong GROWTH beats highs\nlower misses, x" + "y" * 5000 + "low"
    low = F.lower(F.lit(text))
    assert value(spark, tx.count_words_with(low, tx.POSITIVE_WORDS)) == 4
    assert value(spark, tx.count_words_with(low, tx.NEGATIVE_WORDS)) == 3


@pytest.mark.parametrize("text,kind", [
    ("quarterly results beat estimates", "EARNINGS_BEAT"), ("team beaten in quarterly game", "OTHER"),
    ("profit fell short", "EARNINGS_MISS"), ("cool new idea", "MANAGEMENT_CHANGE"), ("nothing here", "OTHER")])
def test_classifier(spark, text, kind):
    assert value(spark, tx.classify_event(F.lit(text))) == kind


@pytest.mark.parametrize("content,found", [
    ('{"a":1}', "whole"), ('```json\n{"a":1}\n```', "whole"), ('Sure: {"a":1} ok', "span"), ("no json", "raw"), ("", "raw"), ("[1]", "raw")])
def test_json_salvage(spark, content, found):
    s = tx.salvage_json(F.lit(content))
    assert value(spark, s["found"]) == found


SOURCES = [("news_1", "acme opened seven large factories across northern europe during spring while hiring engineers quickly"),
           ("news_2", "completely unrelated cooking recipe involving tomatoes garlic basil olive oil salt pepper onions water"),
           ("news_3", "short text"), ("news_4", "acme quarterly margin improved strongly because logistics costs dropped sharply everywhere outside asia")]


@pytest.mark.parametrize("claim,cited,want", [
    ("acme opened factories in europe", ["news_1"], ["news_1"]),
    ("acme opened factories in europe", ["news_2"], []),
    ("acme opened factories in europe", ["news_1", "news_2"], ["news_1"]),
    ("acme opened factories in europe", ["news_3"], ["news_3"]),
    ("acme", ["news_2"], ["news_2"]),
    ("acme opened factories and margin improved strongly", ["news_1", "news_4"], ["news_1", "news_4"]),
    ("acme opened factories in europe", [], []),
    ("acme opened factories in europe", ["gone"], [])])
def test_citation_support(spark, claim, cited, want):
    claims = spark.createDataFrame([(1, claim, cited)], "claim_id long, claim string, evidence_ids array<string>")
    out = evidence.supported_evidence(claims, spark.createDataFrame(SOURCES, "source_id string, content string"))
    assert out.first()["supported"] == want


def test_financial_coverage(spark):
    rows = [(1, 0.1, 0.1, 0.1, 0.1, None, 1.0, 1.0, 0.1, 0.1, 0.1, 0.1, "2026-06-30"),
            (2, float("nan"), float("inf"), None, None, -1.0, -1.0, None, None, None, None, None, "2001-01-01")]
    df = spark.createDataFrame(rows, "company_id long, roe double, net_margin double, roa double, debt_equity double, pe_ratio double, "
                                     "ps_ratio double, pb_ratio double, fcf_yield double, revenue_growth double, earnings_growth double, "
                                     "fcf_growth double, reporting_period string")
    as_of = F.lit(dt.datetime(2026, 9, 1))
    out = {r["company_id"]: r for r in fundamentals.financial_completeness(df.withColumn("metrics_ts", as_of), as_of).collect()}
    assert out[1]["financial_quality"] == 1.0 and out[1]["missing_valuation"] == ["pe_ratio"]
    assert out[2]["financial_quality"] == 0.0 and out[2]["fallback_components"] == ["fundamental", "valuation", "growth"]


def test_repair_statuses(spark):
    df = spark.createDataFrame([('{"summary":"a"}',), ('{"insights":"x"}',), ('[1]',)], "t string").select(F.parse_json("t").alias("r"))
    assert [r["status"] for r in validation.repair(df, "r").collect()] == ["valid", "repaired", "wrapped"]


def test_merge_prefers_earlier_or_score(spark):
    a = spark.createDataFrame([(1, "d", 0.6)], "query_id int, id string, score double")
    b = spark.createDataFrame([(1, "d", 0.95), (1, "e", 0.1)], "query_id int, id string, score double")
    early = {r["id"]: r["score"] for r in retrieval.merge_hits([a, b]).collect()}
    best = {r["id"]: r["score"] for r in retrieval.merge_hits([a, b], prefer_earlier=False).collect()}
    assert early == {"d": 0.6, "e": 0.1} and best == {"d": 0.95, "e": 0.1}


def test_ranking_limit_and_ties(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([.9, .5, .7, .3])] + [(2, i, .5) for i in range(3)],
                               "query_id int, id int, score double")
    out = retrieval.rank_hits(df, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in out] == [(1, 0), (1, 2), (2, 0), (2, 1)]


def test_wrong_query_dimension_fails(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="dimensions"):
        retrieval.similarity_search(docs, q, 2).collect()


def test_blocks_and_limits_change_no_hit(spark):
    import random

    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    rows = [(i, vec()) for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, rows[0][1]), (41, None), (42, [0.0] * 4), (43, [1.0])], "id long, embedding array<double>")
    asked = [(i, vec()) for i in range(9)]
    q = spark.createDataFrame([*asked, (9, [0.0] * 4)], "query_id long, embedding array<double>")

    def cosine(a, b):
        dot = lambda x, y: sum(i * j for i, j in zip(x, y))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    want = {(i, j, round(cosine(a, b), 9)) for i, a in [*rows, (40, rows[0][1])] for j, b in asked if cosine(a, b) > 0.2}
    for block in (2, 100):
        got = {(r["id"], r["query_id"], round(r["score"], 9)) for r in retrieval.similarity_pairs(docs, q, 4, 0.2, block=block).collect()}
        assert got == want
    top = {(r["query_id"], r["id"]) for r in retrieval.similarity_search(docs, q, 4, 0.2, 3).collect()}
    assert top == {(j, i) for j in range(9) for _, i in sorted((-s, i) for i, k, s in want if k == j)[:3]}


def test_keyword_scores(spark):
    docs = spark.createDataFrame([(1, "Big bank merger " * 10), (2, "a be"), (3, None), (4, "bank")], "id long, content string")
    q = spark.createDataFrame([(1, "Bank merger"), (2, "be"), (3, None)], "query_id int, query string")
    got = {(r["query_id"], r["id"]): round(r["score"], 6) for r in retrieval.keyword_pairs(docs, q, block=1).collect()}
    assert got == {(1, 1): 0.7, (1, 4): 0.7, (2, 2): 0.5}


def test_missing_metadata_counts_as_zero(spark):
    docs = spark.createDataFrame([(1, "news", None), (2, "news", 0.5)], "id long, entity_type string, importance double").withColumn(
        "published_at", F.lit(dt.datetime(2020, 1, 1)))
    keep = lambda low: [r["id"] for r in docs.filter(retrieval.Filters(("news",), minimum={"importance": low}).condition()).collect()]
    assert keep(0.0) == [1, 2] and keep(0.1) == [2]


def test_embedding_isolates_the_bad_item(spark):
    def encoder(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    items = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "ccc")], "id long, text string").coalesce(1)
    out = {r["id"]: r["embedding"] for r in embedding.embed(items, "text", encoder).collect()}
    assert out == {1: [1.0], 2: None, 3: [3.0]}


def test_portfolio_caps_and_cash(spark):
    rows = [(1, f"t{i}", i, 50.0 + i, 40.0, "A" if i < 6 else "B", 0.3) for i in range(8)] + [(1, "T0", 99, 99.0, 1.0, "Z", 0.3)]
    df = spark.createDataFrame(rows, "portfolio_id long, ticker string, seq int, score double, risk_score double, sector string, volatility double")
    df = df.withColumns({"risk_profile": F.lit("moderate"), "max_position_weight": F.lit(0.12), "max_sector_weight": F.lit(0.3),
                         "capital": F.lit(1000.0), "cash_reserve": F.lit(100.0)})
    w = portfolio.target_weights(df, ["portfolio_id"])
    got = {r["ticker"]: (r["sector"], r["weight"]) for r in w.collect()}
    assert len(got) == 8 and got["T0"][0] == "A"
    sums = {}
    for s, x in got.values():
        sums[s] = sums.get(s, 0) + x
        assert x <= 0.12 + 1e-12
    assert sums["A"] == pytest.approx(0.3) and sums["B"] <= 0.3
    book = portfolio.portfolio_summary(w, ["portfolio_id"]).first()
    assert book["allocated"] + book["unallocated"] == pytest.approx(900.0)


def test_correlated_risk_needs_no_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    r = rng.normal(0, 1, (4, 30))
    r[3] = 0.5  # constant series
    w, v = np.array([.4, .3, .2, .1]), np.array([.2, .3, .1, .4])
    with np.errstate(all="ignore"):
        corr = np.nan_to_num(np.corrcoef(r))
    np.fill_diagonal(corr, 1)
    want = float(np.sqrt(w @ (np.outer(v, v) * corr) @ w))
    weights = spark.createDataFrame([(1, i, float(w[i]), float(v[i])) for i in range(4)], "p long, asset int, weight double, volatility double")
    rets = spark.createDataFrame([(i, t, float(r[i, t])) for i in range(4) for t in range(30)], "asset int, t int, ret double")
    assert portfolio.correlated_risk(weights, rets, ["p"]).first()["risk"] == pytest.approx(want)


def test_heartbeat_success_survives_a_failure(spark):
    old = spark.createDataFrame([("a", 1, None)], "task string, ok int, bad int")
    new = spark.createDataFrame([("a", None, 5)], "task string, ok int, bad int")
    r = upsert.merge_keep_old(old, new, ["task"], ["ok", "bad"]).first()
    assert (r["ok"], r["bad"]) == (1, 5)


def test_screening_tries_patterns_only_where_their_pieces_are(spark):
    import re

    from tallyvane.functions import text as tx

    texts = ["SELECT a FROM b", "select only", "x -- y", "x;  Drop t", "IGNORE all previous instructions", "ignore the rest", "you  are now a", "act as ", "act ass",
             "new\tinstructions", "<SCRIPT src>", "onerror =", "on error=", "", None, "İ drop table", "override rules", "disregard all prior x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for family in (tx.SQL_PATTERNS, tx.PROMPT_PATTERNS, tx.XSS_PATTERNS):
        got = [r["m"] for r in df.select("i", tx.matched_patterns("t", family).alias("m")).orderBy("i").collect()]
        assert got == [[p for p in family if re.search(p, t or "", re.I | re.A)] for t in texts]
