"""Identifier, name and hash canonicalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: company-name suffixes, removed in this order
NAME_SUFFIXES = ("Inc.", "Inc", "Corp.", "Corp", "Ltd.", "Ltd", "Co.", "Co")
TICKER_PATTERN = r"^[A-Z0-9.\-]{1,20}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_ticker(raw) -> Column:
    """EXCH:ABC -> ABC, ABC.US -> ABC, trimmed upper case."""
    tail = F.substring_index(_c(raw), ":", -1)
    return F.upper(F.trim(F.substring_index(tail, ".", 1)))


def normalize_company_name(name) -> Column:
    out = F.trim(_c(name))
    for suffix in NAME_SUFFIXES:
        pattern = " " + suffix.replace(".", r"\.") + "$"
        out = F.trim(F.regexp_replace(out, pattern, ""))
    return F.lower(out)


def valid_ticker(ticker) -> Column:
    return _c(ticker).rlike(TICKER_PATTERN)


def default_identifier(raw) -> Column:
    """Trim; one to five ASCII letters become upper case."""
    t = F.trim(_c(raw))
    return F.when(t.rlike("^[A-Za-z]{1,5}$"), F.upper(t)).otherwise(t)


def normalizer_chain(raw, chain: list) -> Column:
    """Registered normalisers, last registered first; the default rule if there is none."""
    if not chain:
        return default_identifier(raw)
    return reduce(lambda c, fn: fn(c), reversed(chain), F.trim(_c(raw)))


def pad_cik(cik) -> Column:
    return F.lpad(_c(cik).cast("string"), 10, "0")


def news_hash(title, published, external_id, source) -> Column:
    """Dedup hash: provider id when there is one, else title and publication time."""
    t = F.lower(F.trim(F.coalesce(_c(title), F.lit(""))))
    has_id = (F.coalesce(_c(external_id), F.lit("")) != "") & (F.coalesce(_c(source), F.lit("")) != "")
    return F.sha2(F.when(has_id, F.concat_ws("|", _c(source), _c(external_id), t))
                  .otherwise(F.concat_ws("|", t, F.coalesce(_c(published), F.lit("")))), 256)


def content_hash(title, url, published_iso) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(url), F.lit("")),
                              _c(published_iso)), 256)


def source_id(entity_type, entity_id) -> Column:
    return F.concat_ws("_", _c(entity_type), _c(entity_id).cast("string"))


def route_template(path) -> Column:
    """Replace UUID and numeric path segments by ``{id}``."""
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    return F.array_join(
        F.transform(F.split(_c(path), "/"),
                    lambda s: F.when(s.rlike(uuid) | s.rlike("^[0-9]+$"), "{id}").otherwise(s)), "/")


# fixed value: form of a generic identifier
IDENTIFIER_PATTERN = r"^[A-Za-z0-9.\-_]{1,100}$"


def valid_identifier(raw) -> Column:
    """The stripped identifier if it has the generic form, else null."""
    t = F.trim(_c(raw))
    return F.when(t.rlike(IDENTIFIER_PATTERN), t)
