"""URL filter: host rules first, else membership in a list of canonical URLs.

Membership is a Bloom filter followed by an exact join. The filter is blocked: one
hash names a 512-bit block, others name bits in it, so a lookup touches one row of
the filter table. It is a table keyed by block and grows with the list; Spark
broadcasts it only while its measured size is below the session's limit, and
otherwise shuffles 8-byte hashes of distinct URLs against it. Only possible hits
carry their URL on to the exact hash join, which removes false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that do not select content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
WORDS_PER_BLOCK = 8  # of 64 bits
PROBES = 6


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path before ``?`` or ``#``; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, lower_ascii(host)).otherwise(""), F.when(has, path).otherwise("")


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slashes, other query parameters in byte order.

    Scheme, fragment and tracking parameters are dropped. Null without ``://``.
    """
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    query = F.array_join(kept, "&")
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)),
                  F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule whose host is the host or a parent of it and whose path starts the path."""
    best = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        best = F.when(fits, F.lit(str(rule))).otherwise(best)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return best, verdict


def _probes(key: Column) -> list[tuple[Column, Column]]:
    """(word, bit) pairs inside a block, each from nine bits of a second hash."""
    h = F.xxhash64(key, F.lit(7))
    return [(F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(7)), F.shiftrightunsigned(h, 9 * i + 3).bitwiseAND(F.lit(63)))
            for i in range(PROBES)]


def _masks(key: Column) -> list[Column]:
    probes = _probes(key)
    out = []
    for word in range(WORDS_PER_BLOCK):
        mask = F.lit(0).cast("long")
        for w, bit in probes:
            mask = mask.bitwiseOR(F.when(w == word, F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")))
                                  .otherwise(F.lit(0).cast("long")))
        out.append(mask.alias(f"m{word}"))
    return out


def _blocks(n_listed: int, bits_per_url: int) -> int:
    return max(1, -(-n_listed * bits_per_url // (64 * WORDS_PER_BLOCK)))


def bloom_table(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7) of a column ``key`` of 64-bit hashes; partial ORs run before the shuffle."""
    masks = keys.select(F.pmod("key", F.lit(n_blocks)).alias("block"), *_masks(F.col("key")))
    return masks.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS_PER_BLOCK)])


def listed_urls(urls: DataFrame, listed: DataFrame, bits_per_url: int = 12) -> DataFrame:
    """Distinct canonical URLs of ``urls`` that are in ``listed``; both have a column ``canonical``, nulls never match."""
    wanted = listed.where(F.col("canonical").isNotNull()).select("canonical").distinct()
    n_blocks = _blocks(wanted.count(), bits_per_url)
    bloom = bloom_table(wanted.select(F.xxhash64("canonical").alias("key")), n_blocks)
    urls = urls.where(F.col("canonical").isNotNull()).select("canonical", F.xxhash64("canonical").alias("key"))
    hashed = urls.select("key").distinct().withColumn("block", F.pmod("key", F.lit(n_blocks)))
    masks = _masks(F.col("key"))
    hit = F.lit(True)
    for i, mask in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    possible = hashed.join(bloom, "block").where(hit).select("key")
    # only possible hits carry their URL on; the exact join decides
    survivors = urls.join(possible, "key", "left_semi").select("canonical").distinct()
    return survivors.join(wanted, "canonical", "left_semi")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], bits_per_url: int = 12) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    ``pages`` has page_id and url, ``listed`` has url; other columns are ignored. A
    rule's verdict wins; without a rule the verdict is ``block`` for a listed URL
    and ``allow`` else. Null urls and urls without ``://`` have empty host and path
    and are allowed. Repeated rows and a hot URL give a row each; the URL is looked
    up once. An empty list allows all, an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select(
        "page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    open_ = rows.where(F.col("rule").isNull())
    bad = listed_urls(open_, listed.select(canonical(F.col("url")).alias("canonical")), bits_per_url)
    ruled = rows.where(F.col("rule").isNotNull()).drop("canonical")
    judged = (open_.drop("verdict").join(bad.withColumn("verdict", F.lit("block")), "canonical", "left")
              .withColumn("verdict", F.coalesce("verdict", F.lit("allow"))))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return judged.select(columns).unionByName(ruled.select(columns))
