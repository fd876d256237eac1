"""Word-list scoring, event classification, screening and text clean-up.

All rules are built-in expressions over the whole text. Word tests use one
anchored regular expression per list, so a text is scanned once per list and a
long token without spaces costs linear time.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.functions.numeric import clamp

# fixed values: sentiment keywords
POSITIVE_WORDS = (
    "beat", "surpass", "exceed", "strong", "growth", "profit", "gain",
    "upgrade", "bullish", "positive", "record", "high", "raise", "boost",
    "opportunity", "optimistic", "recovery", "expand", "increase", "outperform",
)
NEGATIVE_WORDS = (
    "miss", "fall", "decline", "loss", "weak", "downgrade", "bearish",
    "negative", "low", "cut", "reduce", "risk", "threat", "lawsuit",
    "investigation", "regulatory", "plunge", "drop", "fear", "concern",
    "warning", "caution", "trouble", "crisis", "recession",
)
# fixed values: source credibility; the source name is lower-cased before the test
CREDIBLE_HIGH = ("SEC", "reuters", "bloomberg", "wsj", "ft.com", "cnbc")
CREDIBLE_MEDIUM = ("massive", "finnhub", "marketwatch", "seekingalpha")
# fixed values: source reliability, first contained key wins
SOURCE_RELIABILITY = (
    ("sec", 1.00), ("regulatory", 1.00), ("company_ir", 0.95), ("major_financial_news", 0.90),
    ("fmp", 0.90), ("twelve_data", 0.85), ("massive", 0.85), ("finnhub", 0.80),
)
# fixed values: source priority, lower is more authoritative
SOURCE_PRIORITY = (
    ("sec", 1), ("fred", 1), ("twelve_data", 2), ("massive", 2), ("fmp", 3),
    ("finnhub", 4), ("alpha vantage", 4), ("newsapi", 5),
)

# fixed values: earnings tokens
EARNINGS_CONTEXT = ("earnings", "revenue", "eps", "profit", "quarterly", "results", "estimates", "expectations")
BEAT_TOKENS = ("beat", "beats", "exceeded", "exceeds", "surpassed", "surpasses", "above")
MISS_TOKENS = ("miss", "misses", "missed", "fell", "falls", "below", "short")
# fixed values: phrase rules in order of precedence, after the two earnings token rules
PHRASE_RULES = (
    ("EARNINGS_IN_LINE", (
        "earnings report", "quarterly results", "reported earnings", "reports quarterly earnings",
        "reports earnings", "earnings call", "earnings season", "fiscal q1", "fiscal q2", "fiscal q3",
        "fiscal q4", "q1 earnings", "q2 earnings", "q3 earnings", "q4 earnings")),
    ("REGULATORY", (
        "regulatory approval", "sec investigation", "sec charges", "doj investigation", "antitrust", "fines")),
    ("LEGAL", ("lawsuit", "litigation", "settlement", "patent", "court ruling")),
    ("MA", ("acquire", "acquisition", "merger", "buyout", "takeover")),
    ("MANAGEMENT_CHANGE", (
        "ceo", "cfo", "coo", "resign", "appoint", "step down", "chief executive", "chief financial")),
    ("DIVIDEND_CHANGE", ("dividend", "payout")),
    ("STOCK_SPLIT", ("stock split", "reverse split")),
    ("BUYBACK", ("buyback", "repurchase", "share repurchase")),
    ("PRODUCT_LAUNCH", ("launch", "unveil", "announce product", "new product")),
    ("GUIDANCE_UPDATE", ("guidance", "outlook", "forecast", "raise guidance", "lower guidance")),
    ("MACRO_EVENT", (
        "interest rate", "federal reserve", "fed funds", "treasury", "inflation", "gdp growth", "unemployment")),
    ("INSIDER_TRADING", ("insider", "director purchase", "officer sell")),
    ("INSTITUTIONAL_CHANGE", ("fund ownership", "institutional", "13f", "stake")),
    ("ANALYST", ("analyst", "upgrade", "downgrade", "price target", "rating")),
    ("SUPPLY_CHAIN", ("supply chain", "supplier", "shortage", "disruption", "inventory")),
)
# fixed values: event type -> (materiality weight, half-life in days)
EVENT_TYPES = {
    "EARNINGS_BEAT": (0.95, 30.0),
    "EARNINGS_MISS": (0.95, 30.0),
    "EARNINGS_IN_LINE": (0.60, 14.0),
    "REGULATORY": (0.85, 45.0),
    "PRODUCT_LAUNCH": (0.70, 21.0),
    "MA": (0.90, 60.0),
    "MANAGEMENT_CHANGE": (0.65, 21.0),
    "GUIDANCE_UPDATE": (0.80, 30.0),
    "DIVIDEND_CHANGE": (0.55, 21.0),
    "STOCK_SPLIT": (0.40, 14.0),
    "BUYBACK": (0.60, 21.0),
    "MACRO_EVENT": (0.75, 7.0),
    "SECTOR_EVENT": (0.50, 14.0),
    "INSIDER_TRADING": (0.45, 14.0),
    "INSTITUTIONAL_CHANGE": (0.40, 14.0),
    "ANALYST": (0.50, 7.0),
    "SUPPLY_CHAIN": (0.65, 14.0),
    "LEGAL": (0.80, 45.0),
    "OTHER": (0.20, 3.0),
}
DEFAULT_WEIGHT, DEFAULT_HALF_LIFE = 0.20, 7.0

# fixed values: threat patterns
SQL_PATTERNS = (
    r"(\bSELECT\b.*\bFROM\b)", r"(\bINSERT\b.*\bINTO\b)", r"(\bUPDATE\b.*\bSET\b)", r"(\bDELETE\b.*\bFROM\b)",
    r"(\bDROP\b.*\bTABLE\b)", r"(\bUNION\b.*\bSELECT\b)", r"(--\s)", r"(;\s*DROP\s)",
)
PROMPT_PATTERNS = (
    r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions|prompts|directions)",
    r"system\s+prompt", r"you\s+are\s+now\s+", r"act\s+as\s+", r"disregard\s+(all\s+)?(previous|prior)\s+",
    r"forget\s+(all\s+)?(previous|prior)\s+", r"new\s+instructions", r"override\s+(all\s+)?(instructions|rules)",
)
XSS_PATTERNS = (r"(<script[^>]*>)", r"(javascript:)", r"(onerror\s*=)", r"(onload\s*=)")

# fixed values: words that say nothing about whether a claim is supported
SUPPORT_STOPWORDS = (
    "the", "and", "or", "of", "in", "on", "at", "to", "for", "with",
    "from", "by", "as", "is", "are", "was", "were", "has", "have",
    "had", "its", "this", "that", "will", "would", "could", "should",
    "may", "can", "new", "vs", "versus", "per", "over", "about",
)

_SPACE = r"\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _alternatives(keys) -> str:
    """Alternation grouped by first letter: most positions fail on one comparison."""
    groups: dict[str, list[str]] = {}
    for key in keys:
        groups.setdefault(key[0], []).append(re.escape(key[1:]))
    return "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in groups.items())


def count_words_with(lowered: Column, keys) -> Column:
    """Number of space-separated words that contain any of the keys.

    A match runs from the first key in a word to the end of that word, so each
    word counts once and the text is read once.
    """
    first = "".join(sorted({k[0] for k in keys}))
    return F.regexp_count(lowered, F.lit(f"(?=[{first}])(?:{_alternatives(keys)})[^{_SPACE}]*"))


def sentiment(positive, negative) -> dict[str, Column]:
    """sentiment, magnitude and confidence from the two word counts."""
    p, n = _c(positive), _c(negative)
    total = p + n
    return {
        "sentiment": F.when(total == 0, 0.0).otherwise(F.bround((p - n) / total, 4)),
        "magnitude": F.when(total == 0, 0.0).otherwise(F.bround(F.least(F.lit(1.0), total / 10), 4)),
        "confidence": F.when(total == 0, 0.3).otherwise(F.bround(F.least(F.lit(1.0), 0.5 + total * 0.05), 4)),
    }


def relevance(text, ticker, name=None) -> Column:
    """0.95 ticker, 0.90 full name, up to 0.8 for name words, else 0.3."""
    t = F.lower(_c(text))
    rule = F.when(F.contains(t, F.lower(_c(ticker))), 0.95)
    if name is None:
        return rule.otherwise(0.3)
    nm = F.lower(_c(name))
    words = F.size(F.filter(F.split(F.trim(nm), r"\s+"), lambda w: (F.length(w) > 3) & F.contains(t, w)))
    return (rule.when((nm != "") & F.contains(t, nm), 0.90)
            .when((nm != "") & (words > 0), F.least(F.lit(0.8), 0.5 + words * 0.1)).otherwise(0.3))


def _contains_any(text: Column, keys) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keys])


def credibility(source) -> Column:
    s = F.lower(_c(source))
    return (F.when(_contains_any(s, CREDIBLE_HIGH), 0.95)
            .when(_contains_any(s, CREDIBLE_MEDIUM), 0.80).otherwise(0.60))


def source_reliability(source, default: float = 0.5) -> Column:
    s = F.lower(_c(source))
    out = None
    for key, value in SOURCE_RELIABILITY:
        hit = F.contains(s, F.lit(key))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def source_priority(source) -> Column:
    s = F.lower(F.trim(_c(source)))
    table = F.create_map(*[F.lit(x) for pair in SOURCE_PRIORITY for x in pair])
    return F.coalesce(F.try_element_at(table, s), F.lit(99))


def has_token(lowered: Column, tokens) -> Column:
    """Is one of the tokens a whole [a-z0-9]+ word of the text?"""
    return lowered.rlike(f"(?:^|[^a-z0-9])(?:{'|'.join(tokens)})(?:[^a-z0-9]|$)")


def classify_event(lowered) -> Column:
    """Event type of a lower-cased text: ordered rules, first hit wins."""
    t = _c(lowered)
    context = has_token(t, EARNINGS_CONTEXT)
    out = F.when(context & has_token(t, BEAT_TOKENS), "EARNINGS_BEAT").when(
        context & has_token(t, MISS_TOKENS), "EARNINGS_MISS")
    for event_type, phrases in PHRASE_RULES:
        out = out.when(_contains_any(t, phrases), event_type)
    return out.otherwise("OTHER")


def _type_lookup(event_type, index: int, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in EVENT_TYPES.items() for x in (k, v[index])])
    return F.coalesce(F.try_element_at(table, _c(event_type)), F.lit(default))


def materiality_weight(event_type) -> Column:
    return _type_lookup(event_type, 0, DEFAULT_WEIGHT)


def impact_label(s) -> Column:
    s = _c(s)
    return F.when(s > 0.2, "positive").when(s < -0.2, "negative").otherwise("neutral")


def impact_score(s) -> Column:
    return F.bround(F.coalesce(F.least(F.lit(1.0), F.abs(_c(s))), F.lit(0.0)), 4)


def event_materiality(event_type, confidence) -> Column:
    """Type weight scaled by half to full with the confidence (NULL: unscaled)."""
    factor = F.coalesce(0.5 + 0.5 * _c(confidence), F.lit(1.0))
    return F.bround(materiality_weight(event_type) * factor, 4)


def blended_materiality(event_type, magnitude, confidence) -> Column:
    base = materiality_weight(event_type) * (0.6 + 0.2 * _c(magnitude) + 0.2 * _c(confidence))
    return F.bround(clamp(base, 0, 1), 4)


def time_decay(published, event_type, as_of) -> Column:
    """0.5 ** (age / half-life of the type); future times count as new."""
    age_days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(_c(published))) / 86_400_000_000.0)
    return clamp(F.pow(F.lit(0.5), age_days / _type_lookup(event_type, 1, DEFAULT_HALF_LIFE)), 0, 1)


def effective_weight(rel, cred, materiality, decay) -> Column:
    return F.bround(clamp(_c(rel) * _c(cred) * _c(materiality) * _c(decay), 0, 1), 4)


# -- screening and clean-up ---------------------------------------------------

def required_literals(pattern: str) -> list[str]:
    """Lower-case pieces that every match of the pattern contains; choices and optional parts give none."""
    plain = re.sub(r"\([^()]*\)\?|\([^()]*\|[^()]*\)", " ", pattern)
    plain = re.sub(r"\[[^\]]*\][*+?]?|\\[bs][*+?]?|\.\*|[()]", " ", plain)
    return plain.lower().split()


def matched_patterns(text, patterns) -> Column:
    """The patterns found in the text. A pattern is only tried on a text that holds its literal pieces."""
    t = _c(text)

    def each(low: Column) -> Column:
        tried = []
        for p in patterns:
            holds = F.lit(True)
            for piece in required_literals(p):
                holds = holds & F.contains(low, F.lit(piece))
            tried.append(F.when(F.when(holds, t.rlike(f"(?id){p}")).otherwise(False), F.lit(p)))
        return F.array_compact(F.array(*tried))

    found = F.element_at(F.transform(F.array(F.lower(t)), each), 1)  # the text is lower-cased once
    return F.coalesce(found, F.array().cast("array<string>"))


def sanitize_html(html) -> Column:
    """Visible text: no script or style blocks, no tags, single spaces."""
    out = F.regexp_replace(_c(html), r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, f"[{_SPACE}]+", " "))


def content_tokens(text) -> Column:
    """Distinct [a-z0-9]+ tokens of three letters or more, without stopwords."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("([a-z0-9]{3,})"))
    return F.array_except(tokens, F.array(*[F.lit(w) for w in SUPPORT_STOPWORDS]))


def salvage_json(content) -> dict[str, Column]:
    """JSON object in a reply: as a whole, inside a code fence, or inside prose.

    ``value`` is a VARIANT object, NULL when nothing parses (``raw`` then holds the text).
    """
    raw = F.coalesce(_c(content), F.lit(""))
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    fenced = F.regexp_replace(t, r"^`+|`+$", "")
    fenced = F.trim(F.regexp_replace(fenced, r"^json", ""))
    t = F.when(F.startswith(t, F.lit("```")), fenced).otherwise(t)
    whole = F.try_parse_json(t)
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    start, tail = F.locate("{", t), F.locate("}", F.reverse(t))
    end = F.length(t) - tail + 1
    span = F.when((start > 0) & (tail > 0) & (end > start), F.substring(t, start, end - start + 1))
    inner = F.try_parse_json(span)
    return {
        "value": F.when(is_object(whole), whole).when(is_object(inner), inner),
        "found": F.when(is_object(whole), "whole").when(is_object(inner), "span").otherwise("raw"),
        "raw": raw,
    }
