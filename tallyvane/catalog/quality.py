"""Queries over validation rules, freshness and source choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.catalog.common import day_text, rnd, sql_day, time_text
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.operators import quality, validation

_N = "CAST(hash_key AS BIGINT)"


@query("price_rule_rejects", "D1 B15", with_views("bars", f"""
    SELECT company_id, {sql_day("ts")}, array_to_string(list_filter([
        CASE WHEN close < 0 THEN 'close missing or negative' END,
        CASE WHEN high < low THEN 'high below low' END, CASE WHEN high < open THEN 'high below open' END,
        CASE WHEN high < close THEN 'high below close' END, CASE WHEN low > open THEN 'low above open' END,
        CASE WHEN low > close THEN 'low above close' END], lambda x: x IS NOT NULL), '; ') AS errors
    FROM (SELECT company_id, ts, open, low, CASE WHEN day(ts) % 5 = 1 THEN -close ELSE close END AS close,
                 CASE WHEN day(ts) % 7 = 2 THEN low - 1 ELSE high END AS high FROM bars)
    WHERE close < 0 OR high < low OR high < open OR high < close OR low > open OR low > close"""))
def price_rule_rejects(m):
    """Bars with a planted negative close or an impossible high."""
    bad = m.bars().withColumn("close", F.when(F.dayofmonth("ts") % 5 == 1, -F.col("close")).otherwise(F.col("close")))
    bad = bad.withColumn("high", F.when(F.dayofmonth("ts") % 7 == 2, F.col("low") - 1).otherwise(F.col("high")))
    out = validation.rejected(validation.check(bad, validation.price_rules()))
    return out.select("company_id", day_text("ts"), F.array_join("errors", "; ").alias("errors"))


@query("statement_rule_rejects", "D2", with_views("statements", """
    SELECT company_id, period, period_type, concat_ws('; ', CASE WHEN period_type = 'monthly' THEN 'invalid period_type' END,
             CASE WHEN total_debt < 0 THEN 'total_debt negative' END, CASE WHEN cash < 0 THEN 'cash negative' END) AS errors,
           currency NOT IN ('USD', 'EUR', 'GBP', 'JPY', 'CNY', 'CAD', 'AUD', 'CHF', 'INR') AS unknown_currency
    FROM (SELECT company_id, period, CASE WHEN period LIKE '1997%' THEN 'monthly' ELSE period_type END AS period_type,
                 CASE WHEN net_income < 0 THEN -total_debt ELSE total_debt END AS total_debt,
                 CASE WHEN free_cash_flow < 0 THEN -cash ELSE cash END AS cash,
                 CASE WHEN period LIKE '%-06-%' THEN 'SEK' ELSE 'USD' END AS currency FROM statements)
    WHERE period_type = 'monthly' OR total_debt < 0 OR cash < 0"""))
def statement_rule_rejects(m):
    s = m.statements().withColumn("period_type", F.when(F.startswith("period", F.lit("1997")), "monthly")
                                  .otherwise(F.col("period_type")))
    s = s.withColumn("total_debt", F.when(F.col("net_income") < 0, -F.col("total_debt")).otherwise(F.col("total_debt")))
    s = s.withColumn("cash", F.when(F.col("free_cash_flow") < 0, -F.col("cash")).otherwise(F.col("cash")))
    s = s.withColumn("currency", F.when(F.contains("period", F.lit("-06-")), "sek").otherwise("usd"))
    out = validation.rejected(validation.check(s, validation.statement_rules()))
    return out.select("company_id", "period", "period_type", F.array_join("errors", "; ").alias("errors"),
                      validation.currency_warning("currency").alias("unknown_currency"))


@query("news_rule_rejects", "D3", with_views("news", """
    SELECT news_id, concat_ws('; ', CASE WHEN news_id % 4 = 0 THEN 'title empty' END,
             CASE WHEN news_id % 6 = 0 THEN 'published_at missing' END,
             CASE WHEN news_id % 5 = 0 THEN 'sentiment out of range' END) AS errors
    FROM news WHERE news_id % 4 = 0 OR news_id % 6 = 0 OR news_id % 5 = 0"""))
def news_rule_rejects(m):
    n = m.news().select(
        "news_id", F.when(F.col("news_id") % 4 != 0, F.col("title")).alias("title"),
        F.when(F.col("news_id") % 6 != 0, F.col("published_at")).alias("published_at"),
        F.when(F.col("news_id") % 5 == 0, -1.5).otherwise(0.5).alias("sentiment"))
    out = validation.rejected(validation.check(n, validation.news_rules()))
    return out.select("news_id", F.array_join("errors", "; ").alias("errors"))


@query("macro_rule_rejects", "D4", with_views("macro", f"""
    SELECT indicator, {sql_day("ts")}, 'value not numeric' AS errors FROM macro WHERE month(ts) = 6"""))
def macro_rule_rejects(m):
    x = m.macro().withColumn("value", F.when(F.month("ts") == 6, "n/a").otherwise(F.col("value").cast("string")))
    out = validation.rejected(validation.check(x, validation.macro_rules()))
    return out.select("indicator", day_text("ts"), F.array_join("errors", "; ").alias("errors"))


@query("range_rule_rejects", "C28", """
    SELECT s_suppkey, o_orderkey, concat_ws('; ', CASE WHEN a > b THEN 'start after end' END,
           CASE WHEN date_diff('day', a, b) > 1500 THEN 'range too long' END) AS errors
    FROM (SELECT o_orderkey, o_custkey AS s_suppkey, CAST(o_orderdate AS DATE) AS a,
                 CAST(o_orderdate AS DATE) + CAST((o_orderkey % 40 - 5) * 60 AS INTEGER) AS b FROM orders)
    WHERE a > b OR date_diff('day', a, b) > 1500""")
def range_rule_rejects(m):
    """Date ranges made from the orders, with a 1500 day limit."""
    o = m.table("orders").select("o_orderkey", F.col("o_custkey").alias("s_suppkey"), F.to_date("o_orderdate").alias("a"))
    o = o.withColumn("b", F.date_add("a", ((F.col("o_orderkey") % 40 - 5) * 60).cast("int")))
    out = validation.rejected(validation.check(o, validation.date_range_rules("a", "b", 1500)))
    return out.select("s_suppkey", "o_orderkey", F.array_join("errors", "; ").alias("errors"))


_STRATEGIES = ("score_threshold", "momentum", "equal_weight", "portfolio_optimizer", "martingale")


@query("backtest_spec_rejects", "D20", """
    SELECT o_orderkey, concat_ws('; ',
        CASE WHEN s = 'martingale' THEN 'unsupported strategy' END, CASE WHEN q <= 2 THEN 'end not after start' END,
        CASE WHEN s = 'equal_weight' THEN 'equal_weight: unknown parameter' END,
        CASE WHEN s = 'momentum' THEN 'momentum: unknown parameter' END,
        CASE WHEN s = 'portfolio_optimizer' THEN 'portfolio_optimizer: unknown parameter' END,
        CASE WHEN s = 'score_threshold' AND t > 100 THEN 'score_threshold: bad threshold' END,
        CASE WHEN s = 'score_threshold' AND q % 2 = 1 THEN 'score_threshold: bad rebalance_days' END,
        CASE WHEN s = 'momentum' AND q % 2 = 1 THEN 'momentum: bad rebalance_days' END,
        CASE WHEN s = 'portfolio_optimizer' AND q % 2 = 1 THEN 'portfolio_optimizer: bad rebalance_days' END) AS errors
    FROM (SELECT o_orderkey, (['score_threshold', 'momentum', 'equal_weight', 'portfolio_optimizer', 'martingale'])[o_orderkey % 5 + 1] AS s,
                 o_orderkey % 130 AS t, o_orderkey % 17 AS q FROM orders)
    WHERE s <> 'score_threshold' OR q <= 2 OR t > 100 OR q % 2 = 1""")
def backtest_spec_rejects(m):
    """One run spec per order: odd days are given as fractions, thresholds run up to 129."""
    k = F.col("o_orderkey")
    days = F.when(k % 17 % 2 == 1, F.lit("2.5")).otherwise(F.lit("21"))
    spec = m.table("orders").select(
        "o_orderkey", F.element_at(F.array(*[F.lit(s) for s in _STRATEGIES]), (k % 5 + 1).cast("int")).alias("strategy"),
        F.create_map(F.lit("threshold"), (k % 130).cast("string"), F.lit("rebalance_days"), days).alias("parameters"),
        F.to_date("o_orderdate").alias("start_date"),
        F.date_add(F.to_date("o_orderdate"), (k % 17 - 2).cast("int")).alias("end_date"))
    out = validation.rejected(validation.check(spec, validation.backtest_parameter_rules()))
    return out.select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


@query("data_age_report", "D5 D6", with_views("news facts", """
    SELECT news_id, round(age, 3) AS age_seconds,
           CASE WHEN age <= 60 THEN 'real_time' WHEN age <= 300 THEN 'near_real_time' WHEN age <= 900 THEN 'delayed'
                WHEN age <= 86400 THEN 'daily' WHEN age <= 7776000 THEN 'quarterly' ELSE 'annual' END AS freshness,
           age <= 86400 AS is_fresh, age <= CASE WHEN news_id % 2 = 0 THEN 86400 ELSE 7776000 END AS fresh_enough
    FROM (SELECT news_id, date_diff('microsecond', published_at, as_of + INTERVAL 40 SECOND) / 1000000.0 AS age FROM news, facts)"""))
def data_age_report(m):
    from datetime import timedelta

    now = F.lit(m.as_of + timedelta(seconds=40))
    rows = m.news().select("news_id", "published_at", F.when(F.col("news_id") % 2 == 0, "daily").otherwise("quarterly").alias("expected"))
    out = quality.freshness_gate(quality.data_age(rows, "published_at", now), "published_at", "expected", now)
    return out.select("news_id", *rnd("age_seconds", digits=3), "freshness", "is_fresh", "fresh_enough")


def quoted_closes(m):
    """Three vendors quote each bar: exact, 0.4 % off, and (in odd months) 10 % off."""
    src = F.array(F.struct(F.lit("finnhub").alias("source"), F.lit(1.0).alias("f"), F.lit(0).alias("seq")),
                  F.struct(F.lit("FMP").alias("source"), F.lit(1.004).alias("f"), F.lit(1).alias("seq")),
                  F.struct(F.lit("massive").alias("source"), F.lit(1.1).alias("f"), F.lit(2).alias("seq")))
    rows = m.bars().select("company_id", "ts", "close", F.explode(src).alias("s"))
    rows = rows.select("company_id", "ts", "s.source", "s.seq", (F.col("close") * F.col("s.f")).alias("close"))
    return rows.filter((F.col("seq") < 2) | (F.month("ts") % 2 == 1))


@query("best_source_rows", "D8 D7", with_views("bars", f"""
    SELECT company_id, {sql_day("ts")}, CASE WHEN month(ts) % 2 = 1 THEN 'massive' ELSE 'FMP' END AS source,
           round(close * CASE WHEN month(ts) % 2 = 1 THEN 1.1 ELSE 1.004 END, 6) AS close FROM bars"""))
def best_source_rows(m):
    out = quality.best_source(quoted_closes(m), ["company_id", "ts"], "source", "seq")
    return out.select("company_id", day_text("ts"), "source", *rnd("close"))


@query("source_agreement", "D9", with_views("bars", f"""
    SELECT company_id, {sql_day("ts")}, n AS source_count, round(CASE WHEN a > 0.99 THEN 1.0 ELSE a END, 3) AS agreement,
           round((n - 1) * 0.05 * CASE WHEN a > 0.99 THEN 1.0 ELSE a END, 3) AS confidence_adjustment
    FROM (SELECT company_id, ts, 2 + (month(ts) % 2 = 1)::BIGINT AS n,
                 CASE WHEN month(ts) % 2 = 1 THEN 1 - greatest(1.1::DOUBLE - (3.104::DOUBLE / 3), 3.104::DOUBLE / 3 - 1) / (3.104::DOUBLE / 3)
                      ELSE 1 - 0.002::DOUBLE / 1.002::DOUBLE END AS a FROM bars)"""))
def source_agreement(m):
    out = quality.source_agreement(quoted_closes(m), ["company_id", "ts"], "close")
    return out.select("company_id", day_text("ts"), "source_count", *rnd("agreement", "confidence_adjustment", digits=3))


@query("provenance_rows", "D10", with_views("news facts", """
    SELECT news_id, source, external_id AS source_id, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at,
           strftime(as_of, '%Y-%m-%dT%H:%M:%S') AS retrieved_at, '1.0' AS data_version FROM news, facts"""))
def provenance_rows(m):
    p = quality.provenance("source", "external_id", "published_at", m.now)
    return m.news().select("news_id", p.alias("p")).select("news_id", "p.*")


def reply_records(m):
    """Parsed replies of several shapes as VARIANT, one per conversation turn."""
    k = (F.col("conv_id") * 3 + F.col("turn")) % 6
    bodies = F.array(
        F.lit('{"summary":"s","insights":["a"],"risks":[],"confidence":0.4}'),
        F.lit('{"insights":"one","risks":["r"],"confidence":1.7}'),
        F.lit('{"summary":"","risks":"x","confidence":true}'),
        F.lit('["a","b"]'),
        F.lit('{"summary":"t","insights":[1,2],"confidence":"0.9"}'),
        F.lit('"text"'))
    return m.table("conversations").select(
        "conv_id", "turn", F.parse_json(F.element_at(bodies, (k + 1).cast("int"))).alias("record"))


_SHAPES = """(VALUES (0, 's', 'a', '', 'valid', ''), (1, 'No summary provided by LLM', 'one', 'r', 'repaired', 'missing required field: summary; insights is not a list'),
    (2, 'No summary provided by LLM', '', 'x', 'repaired', 'missing required field: summary; risks is not a list'),
    (3, '["a","b"]', '', '', 'wrapped', ''), (4, 't', '1,2', '', 'valid', ''), (5, 'text', '', '', 'wrapped', ''))
    v(k, summary, insights, risks, status, issues)"""


@query("repaired_records", "D17", f"""
    SELECT conv_id, turn, summary, insights, risks, status, issues FROM conversations JOIN {_SHAPES} ON (conv_id * 3 + turn) % 6 = k""")
def repaired_records(m):
    out = validation.repair(reply_records(m), "record")
    return out.select("conv_id", "turn", "summary", F.array_join("insights", ",").alias("insights"),
                      F.array_join("risks", ",").alias("risks"), "status", F.array_join("issues", "; ").alias("issues"))


@query("record_checks", "D16 D19", """
    SELECT conv_id, turn, errors, confidence FROM conversations JOIN (VALUES
      (0, '', 0.4), (1, 'missing required field: summary; missing field: summary; insights must be a list; confidence invalid or out of range', NULL),
      (2, 'confidence invalid or out of range', NULL),
      (3, 'missing required field: summary; missing field: summary', NULL),
      (4, 'insights items must be str', 0.9), (5, 'missing required field: summary; missing field: summary', NULL)) v(k, errors, confidence)
    ON (conv_id * 3 + turn) % 6 = k""".replace("(0, '', 0.4)", "(0, '', 0.4::DOUBLE)"))
def record_checks(m):
    rules = (validation.required_rules("record", ["summary"]) + validation.field_rules("record", {"summary": "str"})
             + validation.list_rules("record", "insights", "str") + validation.confidence_rules("record"))
    out = validation.check(reply_records(m), rules)
    return out.select("conv_id", "turn", F.array_join("errors", "; ").alias("errors"),
                      validation.confidence_value("record").alias("confidence"))


def analysis_records(m):
    """Company, risk and portfolio analyses with planted contract breaks."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    good = ('{"summary":"s","market_interpretation":{},"causes":[{"cause":"c","impact":"high","confidence":0.5,"evidence_ids":["news_1"]}],'
            '"bull_case":["b"],"bear_case":[],"investment_thesis":"t","confidence":0.8,"overall_risk_level":"low","risk_factors":[],'
            '"allocation_assessment":"ok","recommendations":[]}')
    bodies = F.array(
        F.lit(good), F.lit(good.replace('"impact":"high"', '"impact":"huge"').replace('"low"', '"none"')),
        F.lit(good.replace('"bull_case":["b"]', '"bull_case":"b"').replace('"recommendations":[]', '"recommendations":"x"')),
        F.lit(good.replace('"confidence":0.8', '"confidence":true').replace('"risk_factors":[],', '')),
        F.lit(good.replace('"cause":"c",', "").replace('"summary":"s",', "")))
    return m.table("conversations").select(
        "conv_id", "turn", F.parse_json(F.element_at(bodies, (k + 1).cast("int"))).alias("record"))


@query("analysis_contract_checks", "D18", """
    SELECT conv_id, turn, company, risk, portfolio FROM conversations JOIN (VALUES
      (0, '', '', ''), (1, 'invalid claim impact', 'invalid overall_risk_level', ''),
      (2, 'bull_case must be a list', '', 'recommendations must be a list'),
      (3, 'invalid confidence', 'missing required field: risk_factors', ''),
      (4, 'missing required field: summary; claim missing cause', 'missing required field: summary', 'missing required field: summary'))
      v(k, company, risk, portfolio) ON (conv_id + turn) % 5 = k""")
def analysis_contract_checks(m):
    r = analysis_records(m)
    join = lambda rules: F.array_join(validation.broken(rules), "; ")
    return r.select("conv_id", "turn", join(validation.company_analysis_rules("record")).alias("company"),
                    join(validation.risk_analysis_rules("record")).alias("risk"),
                    join(validation.portfolio_analysis_rules("record")).alias("portfolio"))
