"""Registered queries of the corpus operators, with the SQL that states the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm import (
    chat_format, decontaminate, host_rules, language_id, near_dedup, quality_model, ranked_search, sharding, source_mix, token_counts,
    toxicity, turn_repair, url_filter,
)
from tallyvane.llm.common import WORD, bucket_of_four, held_out, table
from tallyvane.operators.materialize import stored
from tallyvane.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ship_package(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


# 1 ---------------------------------------------------------------------------------------------------------------

@register
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted, masked and read back."""
    control = "</s>[INST] ok [/INST]"
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    formatted = chat_format.format_chats(conversations.unionByName(probe), tokenizer_file("byte_bpe_50k.json"))
    return chat_format.read_back(formatted)


_CONTROL = "|".join(c.replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in
                    ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
                     "<<SYS>>", "<</SYS>>"))
SQL["op1_chat_formatting"] = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(32 + length(regexp_replace(role, '{_CONTROL}|␛', '\\0_', 'g'))
              + length(regexp_replace(text, '{_CONTROL}|␛', '\\0_', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


# 2 ---------------------------------------------------------------------------------------------------------------

@register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document from labelled documents that are not held out."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(bucket_of_four(F.col("doc_id")) != 2)
    picked = stored(toxicity.draw(labels.select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))), "toxicity-picked")
    # the sample's size is bounded by the parameters of ``draw``
    sample = documents.join(F.broadcast(picked), F.col("doc_id") == F.col("key")).withColumnRenamed("key", "name")
    judge = toxicity.fit_sample(sample, documents)
    scored = toxicity.score(documents.select("doc_id", "text"), judge)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


# 3 ---------------------------------------------------------------------------------------------------------------

RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"),
         url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]
#: First labels of hosts whose pages are listed.
SPAM_HOST = r"^(www\.|m\.|blog\.)?(spam-farm|cheap-pills|casino-win|free-bets|ads-track|adult-x)\."


@register
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against four host rules and the list of URLs seen on spam hosts."""
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filter.host_and_path(F.col("url"))
    listed = pages.where(host.rlike(SPAM_HOST)).select("url")
    return url_filter.filter_urls(pages, listed, RULES)


SQL["op3_url_filter"] = r"""
WITH u AS (
    SELECT page_id, url, coalesce(instr(url, '://') > 0, false) AS has,
           translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
           regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
c AS (
    SELECT page_id, CASE WHEN has THEN h ELSE '' END AS host, CASE WHEN has THEN p ELSE '' END AS path,
           CASE WHEN has THEN regexp_replace(regexp_replace(h, '^www\.', ''), ':(80|443)$', '') || regexp_replace(p, '/+$', '') ||
               coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND split_part(x, '=', 1)
               NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid', 'gclid'))), '&'), ''), '')
           END AS canonical FROM u),
r AS (
    SELECT *, CASE
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c),
listed AS (
    SELECT DISTINCT canonical FROM c
    WHERE regexp_matches(host, '^(www\.|m\.|blog\.)?(spam-farm|cheap-pills|casino-win|free-bets|ads-track|adult-x)\.'))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN listed ON r.canonical = listed.canonical"""


# 4 ---------------------------------------------------------------------------------------------------------------

@register
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from prototypes of the rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    learned = documents.where(bucket_of_four(F.col("doc_id")) != 2)
    profiles = language_id.fit_profiles(learned.select("text", "lang", F.col("doc_id").alias("sample_key")))
    judged = language_id.identify(documents.select("doc_id", "text"), profiles)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# 5 ---------------------------------------------------------------------------------------------------------------

@register
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 by source, at most three times each."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.array("source").alias("sources"))
    mixed = source_mix.mix(stored(documents, "mix-sizes"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


SQL["op5_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
      FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size / w AS cap, (SELECT sum(source_size) FROM s) AS total FROM s),
-- a level such that the sources that stop before it, and the level times the other weights, make the total
lev AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
        FROM r WINDOW before AS (ORDER BY cap, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(first(level ORDER BY cap, source NULLS LAST) FILTER (level <= cap), 0) AS level FROM lev),
t AS (SELECT source, source_size, least(3.0 * source_size, w * level) AS target FROM r, l),
o AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(':' || coalesce(doc_id::VARCHAR, '')), size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, round_even(target, 0)::BIGINT AS quota
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (size * ((2 * before + size <= 2 * quota)::INT + (2 * (before + source_size) + size <= 2 * quota)::INT
              + (2 * (before + 2 * source_size) + size <= 2 * quota)::INT))::BIGINT AS taken
FROM o"""


# 6 ---------------------------------------------------------------------------------------------------------------

@register
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts, equal texts together."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# 7 ---------------------------------------------------------------------------------------------------------------

@register
def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return near_dedup.components(table(spark, sf_dir, "documents"), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")


# 8 ---------------------------------------------------------------------------------------------------------------

@register
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on every document, with the source as its host."""
    documents = table(spark, sf_dir, "documents")
    judged = host_rules.apply_host_rules(documents.select("doc_id", "text", "source"), "source")
    return judged.select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


SQL["op8_host_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
gram AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM win),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM gram WHERE n > 1)
        GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
    SELECT rid, doc_id, source, len(ws)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 1e-12 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 20.0 END AS s FROM moments),
verdicts AS (SELECT source, (failed + m * s) / (n + s) <= 0.5 AS host_ok FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_ok, true) AS kept
FROM judged LEFT JOIN verdicts USING (source)"""


# 9 ---------------------------------------------------------------------------------------------------------------

@register
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    documents = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(documents.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


# 10 --------------------------------------------------------------------------------------------------------------

@register
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by any document, within a fifth of the item's words edited."""
    documents = table(spark, sf_dir, "documents")
    return decontaminate.find_leaks(documents.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


# 11 --------------------------------------------------------------------------------------------------------------

@register
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by a fixed rule, then repaired at the least cost."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turn_repair.repair_report(told, turn_repair.damage(told))


SQL["op11_turn_repair"] = r"""
WITH RECURSIVE
bits AS (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                               lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits),
told AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
drawn AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS what FROM told, crc),
damaged AS (SELECT key, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
                   CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM drawn, range(2) c(copy) WHERE what <> 0 AND (copy = 0 OR what = 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
             left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) AS before FROM r),
n AS (SELECT key, max(i) AS n FROM f GROUP BY key),
-- cost to go: nothing yet, behind s, behind u, behind a
b AS (
    SELECT key, n + 1 AS i, 0::BIGINT AS c0, 6::BIGINT AS c1, 3::BIGINT AS c2, 0::BIGINT AS c3 FROM n
    UNION ALL
    SELECT key, i, least(e0, least(e2, e3 + 3) + 3), least(e1, least(e2, e3 + 3) + 3), least(e2, e3 + 3), least(e3, e2 + 3) FROM (
        SELECT f.key, f.i, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t,
               c2 + t + CASE WHEN c = 'u' THEN 0 ELSE 3 END AS u, c3 + t + CASE WHEN c = 'a' THEN 0 ELSE 3 END AS a,
               CASE WHEN gone THEN 4 + c0 ELSE least(4 + c0, u, CASE WHEN c = 's' THEN c1 + t ELSE 4 + c0 END) END AS e0,
               CASE WHEN gone THEN 4 + c1 ELSE least(4 + c1, u) END AS e1, CASE WHEN gone THEN 4 + c2 ELSE least(4 + c2, a) END AS e2,
               CASE WHEN gone THEN 4 + c3 ELSE least(4 + c3, u) END AS e3
        FROM b JOIN f ON f.key = b.key AND f.i = b.i - 1)),
v AS (SELECT b.key, b.i, [c0, c1, c2, c3] AS c, lead([c0, c1, c2, c3]) OVER (PARTITION BY b.key ORDER BY b.i) AS later,
             role, text, f.c AS letter, fault, n FROM b JOIN n USING (key) LEFT JOIN f ON f.key = b.key AND f.i = b.i),
w AS (
    SELECT key, 1::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS out FROM n
    UNION ALL
    SELECT key, CASE WHEN op = 'I' THEN i ELSE i + 1 END, CASE WHEN op = 'D' THEN s WHEN op = 'K' AND letter = 's' THEN 1 ELSE goal END, audit || op,
           CASE op WHEN 'D' THEN out WHEN 'I' THEN list_append(out, made || ':') WHEN 'K' THEN list_append(out, role || ':' || text)
                   ELSE list_append(out, made || ':' || text) END
    FROM (SELECT w.*, v.role, v.text, v.letter, CASE WHEN s = 2 THEN 3 ELSE 2 END AS goal, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END AS made,
                 CASE WHEN w.i <= n AND c[s + 1] = 4 + later[s + 1] THEN 'D'
                      WHEN c[s + 1] = 3 + c[goal + 1] THEN 'I'
                      WHEN s = 0 AND letter = 's' AND c[1] = later[2] + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END THEN 'K'
                      WHEN letter = left(made, 1) THEN 'K' ELSE 'R' END AS op
          FROM w JOIN v ON v.key = w.key AND v.i = w.i WHERE w.i <= n OR c[s + 1] > 0)),
done AS (SELECT key, audit, sha256(array_to_string(out, chr(10))) AS repaired_sha256 FROM w
         QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(audit) DESC) = 1),
counts AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c0, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS key FROM conversations) o
LEFT JOIN counts USING (key) LEFT JOIN b ON b.key = o.key AND b.i = 1 LEFT JOIN done ON done.key = o.key"""


# 12 --------------------------------------------------------------------------------------------------------------

@register
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SQL["op12_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
i AS (SELECT DISTINCT item_id, text, {_TERMS} AS terms FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(terms) AS term FROM i) GROUP BY ALL),
facts AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, facts GROUP BY term, n_docs),
m AS (SELECT row, doc_id, 100 - 75 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, facts WHERE len(terms) > 0),
s AS (SELECT item_id, text, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10"""


# 13 --------------------------------------------------------------------------------------------------------------

@register
def op13_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, from the good rows that are not held out and unlabelled text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    trusted = table(spark, sf_dir, "labels").where(~apart & (F.col("quality") == 1))
    model = quality_model.fit(documents.where(~apart), trusted)
    scored = quality_model.score(documents, model)
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
