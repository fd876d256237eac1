"""Three statement families merged per (company, period, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions.numeric import first_non_empty

FAMILIES = {
    "income": ("revenue", "gross_profit", "operating_income", "net_income", "eps"),
    "balance": ("total_assets", "total_liabilities", "total_debt", "cash", "shareholders_equity"),
    "cashflow": ("operating_cash_flow", "capital_expenditure", "free_cash_flow"),
}
_KEYS = ["company_id", "period", "period_type"]
_META = ("currency", "filed_date", "source_id")


def merge_families(income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    """Full outer merge; metadata comes from the first family that has it."""
    parts = []
    for name, df in (("income", income), ("balance", balance), ("cashflow", cashflow)):
        parts.append(df.filter(F.col("period") != "").select(
            *_KEYS, *FAMILIES[name], *[F.col(c).alias(f"{name}_{c}") for c in _META]))
    out = parts[0].join(parts[1], _KEYS, "full").join(parts[2], _KEYS, "full")
    meta = {c: first_non_empty(*[f"{n}_{c}" for n in FAMILIES]) for c in _META}
    meta["currency"] = F.coalesce(meta["currency"], F.lit("USD"))
    return out.select(*_KEYS, *[f for fam in FAMILIES.values() for f in fam],
                      *[c.alias(n) for n, c in meta.items()])
