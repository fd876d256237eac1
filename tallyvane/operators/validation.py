"""Row rules: every rule is a Column, a row collects the messages of those it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, str]


def broken(rules: list[Rule]) -> Column:
    """Array of the messages whose violation condition is true (NULL counts as not broken)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules]))


def check(df: DataFrame, rules: list[Rule], column: str = "errors") -> DataFrame:
    return df.withColumn(column, broken(rules))


def accepted(df: DataFrame, column: str = "errors") -> DataFrame:
    return df.filter(F.size(column) == 0).drop(column)


def rejected(df: DataFrame, column: str = "errors") -> DataFrame:
    return df.filter(F.size(column) > 0)


def price_rules() -> list[Rule]:
    c = F.col
    rules = [(c(f).isNull() | F.isnan(c(f)) | (c(f) < 0), f"{f} missing or negative")
             for f in ("open", "high", "low", "close")]
    rules += [(c(f) < 0, f"{f} negative") for f in ("adjusted_close", "volume")]
    rules += [
        (c("high") < c("low"), "high below low"),
        (c("high") < c("open"), "high below open"),
        (c("high") < c("close"), "high below close"),
        (c("low") > c("open"), "low above open"),
        (c("low") > c("close"), "low above close"),
    ]
    return rules


def statement_rules() -> list[Rule]:
    c = F.col
    return [
        (~c("period_type").isin("annual", "quarterly", "ttm") | c("period_type").isNull(), "invalid period_type"),
        (c("total_debt") < 0, "total_debt negative"),
        (c("cash") < 0, "cash negative"),
    ]


# fixed values: currencies that raise no warning
KNOWN_CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CNY", "CAD", "AUD", "CHF", "INR")


def currency_warning(currency) -> Column:
    return ~F.upper(F.col(currency)).isin(*KNOWN_CURRENCIES)


def news_rules() -> list[Rule]:
    return [
        (F.length(F.coalesce("title", F.lit(""))) < 1, "title empty"),
        (F.col("published_at").isNull(), "published_at missing"),
        (~F.col("sentiment").between(-1, 1), "sentiment out of range"),
    ]


def macro_rules() -> list[Rule]:
    value = F.col("value").cast("string").try_cast("double")
    return [(value.isNull(), "value not numeric"), (F.col("ts").isNull(), "timestamp missing")]


def date_range_rules(start: str, end: str, max_days: int = 3650) -> list[Rule]:
    return [
        (F.col(start) > F.col(end), "start after end"),
        (F.datediff(F.col(end), F.col(start)) > max_days, "range too long"),
    ]


# fixed values: parameter domains per strategy: name -> (kind, low, high)
STRATEGY_PARAMETERS = {
    "score_threshold": {"threshold": ("number", 0, 100), "rebalance_days": ("int", 1, 2147483647)},
    "momentum": {"top_n": ("int", 1, 2147483647), "lookback_trading_days": ("int", 1, 2147483647),
                 "rebalance_days": ("int", 1, 2147483647)},
    "equal_weight": {},
    "portfolio_optimizer": {"rebalance_days": ("int", 1, 2147483647), "risk_profile": ("word", None, None),
                            "max_position_weight": ("number", 0, 1), "max_sector_weight": ("number", 0, 1),
                            "volatility_lookback": ("int", 1, 2147483647)},
}
RISK_PROFILES = ("conservative", "moderate", "aggressive")


def backtest_parameter_rules() -> list[Rule]:
    """Rules over (strategy STRING, start_date, end_date, parameters MAP<STRING, STRING>)."""
    strategy, params = F.col("strategy"), F.col("parameters")
    rules: list[Rule] = [
        (~strategy.isin(*STRATEGY_PARAMETERS), "unsupported strategy"),
        (F.col("end_date") <= F.col("start_date"), "end not after start"),
    ]
    for name, domain in STRATEGY_PARAMETERS.items():
        known = F.array(*[F.lit(k) for k in domain]).cast("array<string>")
        mine = strategy == name
        rules.append((mine & (F.size(F.array_except(F.map_keys(params), known)) > 0),
                      f"{name}: unknown parameter"))
        for key, (kind, low, high) in domain.items():
            v = F.try_element_at(params, F.lit(key))
            present = mine & v.isNotNull()
            if kind == "word":
                rules.append((present & ~v.isin(*RISK_PROFILES), f"{name}: bad {key}"))
                continue
            shape = r"^-?[0-9]+$" if kind == "int" else r"^-?[0-9]+(\.[0-9]+)?$"
            n = v.try_cast("double")
            low_ok = n > 0 if (kind == "number" and high == 1) else n >= low
            rules.append((present & ~(v.rlike(shape) & low_ok & (n <= high)), f"{name}: bad {key}"))
    return rules


# -- records of open shape (VARIANT) ------------------------------------------

_TAGS = {"str": ("STRING",), "list": ("ARRAY",), "dict": ("OBJECT",), "int": ("BIGINT",),
         "float": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")}


def _field(record: str, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "variant")


def kind_of(v: Column) -> Column:
    """ARRAY / OBJECT / STRING / BIGINT / DOUBLE / ... of a variant value."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def field_rules(record: str, schema: dict[str, str]) -> list[Rule]:
    """Declared field -> type tag; missing and mistyped fields are reported."""
    rules: list[Rule] = []
    for name, tag in schema.items():
        v = _field(record, name)
        rules.append((v.isNull(), f"missing field: {name}"))
        rules.append((v.isNotNull() & ~kind_of(v).isin(*_TAGS[tag]), f"field {name} expected {tag}"))
    return rules


def required_rules(record: str, names) -> list[Rule]:
    return [(_field(record, n).isNull(), f"missing required field: {n}") for n in names]


def list_rules(record: str, name: str, item: str | None = None) -> list[Rule]:
    v = _field(record, name)
    not_list = v.isNotNull() & (kind_of(v) != "ARRAY")
    rules: list[Rule] = [(not_list, f"{name} must be a list")]
    if item:
        items = F.try_variant_get(record, f"$.{name}", "array<variant>")
        rules.append((~not_list & F.exists(items, lambda x: ~kind_of(x).isin(*_TAGS[item])),
                      f"{name} items must be {item}"))
    return rules


def confidence_value(record: str, name: str = "confidence") -> Column:
    """Number in [0, 1] (numeric text allowed, booleans not); NULL when invalid."""
    v = _field(record, name)
    kind = kind_of(v)
    number = F.when(kind.isin(*_TAGS["number"], "STRING"),
                    F.try_variant_get(record, f"$.{name}", "string").try_cast("double"))
    return F.when(number.between(0, 1), number)


def confidence_rules(record: str, name: str = "confidence") -> list[Rule]:
    v = _field(record, name)
    return [(v.isNotNull() & confidence_value(record, name).isNull(), f"{name} invalid or out of range")]


def member_rules(record: str, name: str, allowed) -> list[Rule]:
    v = F.try_variant_get(record, f"$.{name}", "string")
    return [(v.isNull() | ~v.isin(*allowed), f"invalid {name}")]


# fixed values: required fields of a company analysis and of its claims
COMPANY_FIELDS = ("summary", "market_interpretation", "causes", "bull_case", "bear_case",
                  "investment_thesis", "confidence")
CLAIM_FIELDS = ("cause", "impact", "confidence")
LEVELS = ("high", "medium", "low")


def company_analysis_rules(record: str) -> list[Rule]:
    causes = F.try_variant_get(record, "$.causes", "array<variant>")
    part = lambda c, k: F.try_variant_get(c, f"$.{k}", "variant")
    text = lambda c, k: F.try_variant_get(c, f"$.{k}", "string")
    number = lambda c: text(c, "confidence").try_cast("double")
    rules = required_rules(record, COMPANY_FIELDS)
    rules.append((confidence_value(record).isNull(), "invalid confidence"))
    rules += list_rules(record, "causes", "dict")
    rules += list_rules(record, "bull_case", "str") + list_rules(record, "bear_case", "str")
    lacks = lambda k: lambda c: part(c, k).isNull()
    rules += [(F.exists(causes, lacks(k)), f"claim missing {k}") for k in CLAIM_FIELDS]
    rules.append((F.exists(causes, lambda c: ~text(c, "impact").isin(*LEVELS)), "invalid claim impact"))
    rules.append((F.exists(causes, lambda c: (kind_of(part(c, "confidence")) == "BOOLEAN")
                           | ~F.coalesce(number(c).between(0, 1), F.lit(False))), "invalid claim confidence"))
    rules.append((F.exists(causes, lambda c: part(c, "evidence_ids").isNotNull()
                           & (kind_of(part(c, "evidence_ids")) != "ARRAY")), "evidence_ids must be a list"))
    return rules


def risk_analysis_rules(record: str) -> list[Rule]:
    return (required_rules(record, ("summary", "overall_risk_level", "risk_factors"))
            + member_rules(record, "overall_risk_level", LEVELS) + list_rules(record, "risk_factors"))


def portfolio_analysis_rules(record: str) -> list[Rule]:
    return (required_rules(record, ("summary", "allocation_assessment", "recommendations"))
            + list_rules(record, "recommendations"))


def repair(df: DataFrame, record: str) -> DataFrame:
    """Structural repair: default summary, list coercion, wrapping of non-objects.

    Adds summary, insights, risks (arrays of JSON text), status and issues.
    """
    v = F.col(record)
    is_object = F.coalesce(kind_of(v) == "OBJECT", F.lit(False))
    summary = F.try_variant_get(record, "$.summary", "string")
    no_summary = F.coalesce(summary, F.lit("")) == ""
    issues = [F.when(is_object & no_summary, F.lit("missing required field: summary"))]
    out = {}
    for name in ("insights", "risks"):
        f = _field(record, name)
        is_list = kind_of(f) == "ARRAY"
        text = F.try_variant_get(record, f"$.{name}", "string")
        issues.append(F.when(is_object & f.isNotNull() & ~is_list, F.lit(f"{name} is not a list")))
        items = F.transform(F.try_variant_get(record, f"$.{name}", "array<variant>"),
                            lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
        single = F.when(F.coalesce(text, F.lit("")) != "", F.array(text))
        out[name] = F.coalesce(F.when(is_list, items).otherwise(single), F.array().cast("array<string>"))
    whole = F.coalesce(F.try_variant_get(record, "$", "string"), F.to_json(v))
    found = F.array_compact(F.array(*issues))
    return df.select(
        "*",
        F.when(~is_object, whole).when(no_summary, F.lit("No summary provided by LLM"))
        .otherwise(summary).alias("summary"),
        *[F.when(is_object, c).otherwise(F.array().cast("array<string>")).alias(n) for n, c in out.items()],
        F.when(~is_object, "wrapped").when(F.size(found) > 0, "repaired").otherwise("valid").alias("status"),
        found.alias("issues"))


# -- stored analyses ----------------------------------------------------------

def completed_analysis_rules() -> list[Rule]:
    """Invariants of a completed analysis row."""
    c = F.col
    rules: list[Rule] = [(c("status") != "completed", "status not completed")]
    for f in ("investment_score", "risk_score", "confidence_score", "llm_tokens_used", "duration_seconds"):
        rules.append((c(f).isNull(), f"{f} missing"))
    for f in ("analysis_version", "prompt_version", "llm_model", "summary"):
        rules.append((F.coalesce(c(f), F.lit("")) == "", f"{f} missing"))
    for f in ("market_snapshot", "risk_snapshot"):
        rules.append((c(f).isNull(), f"{f} missing"))
    return rules


def payload_consistency_rules() -> list[Rule]:
    """Score copy equals the row, citations exist, claim counts agree, bounds hold."""
    c = F.col
    return [
        (~c("snapshot_score").eqNullSafe(c("investment_score")), "score copy differs"),
        (~c("snapshot_risk").eqNullSafe(c("risk_score")), "risk copy differs"),
        (F.size(F.array_except("cited", "available")) > 0, "citation without source"),
        (c("stored_claims") != c("payload_claims"), "claim counts differ"),
        (~c("investment_score").between(0, 100), "score out of bounds"),
        (c("risk_score") > c("investment_score") + 50, "risk disproportionate"),
    ]
