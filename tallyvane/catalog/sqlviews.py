"""The same views as plain SQL, used as CTE prefixes of the reference queries."""

from __future__ import annotations

from tallyvane.sources.views import HEADLINES, MACRO_SERIES, NEWS_WINDOW_HOURS

_headlines = "[" + ", ".join(f"'{h}'" for h in HEADLINES) + "]"
_macro_name = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{n}'" for k, n, _ in MACRO_SERIES) + " END"
_macro_scale = "CASE " + " ".join(f"WHEN code = '{k}' THEN {s}" for k, _, s in MACRO_SERIES) + " END"

_measures = ["revenue", "gross_profit", "operating_income", "net_income", "total_assets",
             "total_liabilities", "total_debt", "cash", "shareholders_equity",
             "operating_cash_flow", "free_cash_flow"]

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "facts": ((), """
        SELECT (SELECT max(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) FROM lineitem) AS as_of,
               (SELECT count(*) FROM supplier) AS n_companies"""),
    "companies": ((), """
        SELECT s_suppkey AS company_id, 'S' || s_suppkey AS ticker, s_name AS name,
               r_name AS sector, n_name AS industry
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey"""),
    "trades": ((), """
        SELECT l_suppkey AS company_id, CAST(l_shipdate AS DATE) AS day,
               round(100 + 2 * ln(1 + l_extendedprice / l_quantity), 4) AS price,
               round(100 + 2 * ln(1 + l_extendedprice / l_quantity), 4)
                 * (1 + l_tax - l_discount) AS quote,
               (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576 AS seq,
               l_quantity AS qty
        FROM lineitem"""),
    "bars": (("trades",), """
        SELECT company_id, CAST(day AS TIMESTAMP) AS ts,
               arg_min(quote, seq) AS open, max(greatest(price, quote)) AS high,
               min(least(price, quote)) AS low, arg_max(price, seq) AS close,
               CASE WHEN day(day) % 10 = 0 THEN 0.0 ELSE arg_max(price, seq) END AS adjusted_close,
               CAST(sum(qty) AS BIGINT) AS volume
        FROM trades GROUP BY company_id, day"""),
    "quarterly": ((), """
        SELECT l_suppkey AS company_id,
               last_day(CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) AS DATE)
                        + INTERVAL 2 MONTH) AS "end",
               round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
               round(sum(l_extendedprice * (1 - l_discount) - 0.6 * l_extendedprice), 4) AS gross_profit,
               round(sum(0.2 * l_extendedprice * (1 - l_discount)), 4) AS operating_income,
               round(sum(CASE WHEN l_returnflag = 'R' THEN -0.4 * l_extendedprice
                              ELSE 0.2 * l_extendedprice END), 4) AS net_income,
               round(sum(4 * l_extendedprice), 4) AS total_assets,
               round(sum(2.8 * l_extendedprice), 4) AS total_liabilities,
               round(sum(CASE WHEN l_linestatus = 'O' THEN 2.5 * l_extendedprice
                              ELSE 0.5 * l_extendedprice END), 4) AS total_debt,
               round(sum(0.3 * l_extendedprice), 4) AS cash,
               round(sum(1.2 * l_extendedprice), 4) AS shareholders_equity,
               round(sum(0.35 * l_extendedprice), 4) AS operating_cash_flow,
               round(sum(CASE WHEN l_discount >= 0.07 THEN -0.3 * l_extendedprice
                              ELSE 0.2 * l_extendedprice END), 4) AS free_cash_flow
        FROM lineitem GROUP BY 1, 2"""),
    "statements": (("quarterly",), f"""
        SELECT company_id, strftime("end", '%Y-%m-%d') AS period, period_type, {", ".join(_measures)},
               free_cash_flow - operating_cash_flow AS capital_expenditure,
               net_income / 1000.0 AS eps
        FROM (SELECT *, 'quarterly' AS period_type FROM quarterly
              UNION ALL BY NAME
              SELECT company_id, make_date(year("end"), 12, 31) AS "end",
                     {", ".join(f"round(sum({m}), 4) AS {m}" for m in _measures)},
                     'annual' AS period_type
              FROM quarterly GROUP BY 1, 2)"""),
    "macro": ((), f"""
        SELECT indicator, CAST(month AS TIMESTAMP) AS ts,
               round(avg(o_totalprice) / max(scale), 4) AS value
        FROM (SELECT *, {_macro_name} AS indicator, {_macro_scale} AS scale
              FROM (SELECT o_orderpriority[1:1] || o_orderstatus AS code, o_totalprice,
                           date_trunc('month', CAST(o_orderdate AS DATE)) AS month FROM orders))
        WHERE indicator IS NOT NULL GROUP BY 1, 2"""),
    "news": (("facts",), f"""
        SELECT doc_id AS news_id, source,
               ({_headlines})[doc_id % {len(HEADLINES)} + 1] || ' Supplier#'
                 || lpad(CAST(doc_id % n_companies AS VARCHAR), 9, '0') AS title,
               text AS summary, lang,
               CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id END AS external_id,
               'https://news.example.com/' || doc_id AS url,
               CASE WHEN lang = 'de' THEN 0.1 END::DOUBLE AS sentiment,
               as_of - to_hours(doc_id % {NEWS_WINDOW_HOURS}) AS published_at,
               CASE WHEN doc_id % 2 = 0 THEN 'NASDAQ:S' || (doc_id % n_companies) END AS related
        FROM documents, facts"""),
    "company_news": (("facts",), """
        SELECT doc_id % n_companies AS company_id, doc_id AS news_id,
               CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.85 END::DOUBLE AS relevance,
               CASE WHEN doc_id % 2 = 0 THEN 'ticker' ELSE 'name_match' END AS method
        FROM documents, facts
        UNION ALL
        SELECT (doc_id * 7 + 3) % n_companies, doc_id, 0.4::DOUBLE, 'mention'
        FROM documents, facts WHERE (doc_id * 7 + 3) % n_companies <> doc_id % n_companies"""),
    "vectors": (("facts",), f"""
        SELECT vec_id AS id, (['news', 'event', 'analysis'])[label % 3 + 1] AS entity_type,
               vec_id AS entity_id, coalesce(text, '') AS content,
               vec_id % n_companies AS company_id,
               CASE WHEN vec_id % 4 <> 0 THEN (vec_id % 10) / 10.0 END::DOUBLE AS importance,
               as_of - to_hours(vec_id % {NEWS_WINDOW_HOURS}) AS published_at,
               source, label, embedding
        FROM embeddings LEFT JOIN documents ON vec_id = doc_id CROSS JOIN facts"""),
    "scores": (("statements",), """
        SELECT company_id, CAST(period AS TIMESTAMP) + INTERVAL 45 DAY AS ts,
               round(greatest(0.0, least(100.0, 60 + 150 * (net_income / revenue))), 4)::DOUBLE AS overall_score,
               round(greatest(0.0, least(100.0, 100 * (total_debt / total_assets))), 4)::DOUBLE AS risk_score
        FROM statements WHERE period_type = 'quarterly'"""),
    "analyses": (("facts",), """
        SELECT key AS analysis_id, conv_id % n_companies AS company_id,
               CASE WHEN conv_id % 3 <> 0 THEN conv_id % 5 END AS user_id,
               CASE WHEN turn % 4 = 3 THEN 'failed' ELSE 'completed' END AS status,
               as_of - to_days(CAST(CASE WHEN key % 5 = 0 THEN 0 ELSE key * 7 % 400 END AS INTEGER))
                     + to_hours(key % 24) AS completed_at,
               CASE WHEN key % 11 <> 0 THEN (length(text) % 101)::DOUBLE END AS investment_score,
               (length(text) % 67)::DOUBLE AS risk_score,
               CASE WHEN key % 13 <> 0 THEN (length(text) % 97) / 100.0 END::DOUBLE AS llm_confidence,
               (['bullish', 'bearish', 'neutral', 'sideways'])[length(text) % 4 + 1] AS direction,
               (length(text) % 6)::INTEGER AS source_count, text
        FROM (SELECT *, conv_id * 100 + turn AS key FROM conversations WHERE role = 'assistant'), facts"""),
}


def add_view(name: str, deps: str, sql: str) -> None:
    """Later catalog modules add gold-level CTEs (metrics, risk, events, ...)."""
    VIEWS[name] = (tuple(deps.split()), sql)


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named CTEs and everything they depend on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names.split():
        visit(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes}\n{body.strip()}"
