"""Queries over vectors and texts: search, filters, context, embedding intake."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyvane.catalog.common import rnd
from tallyvane.catalog.registry import query
from tallyvane.catalog.sqlviews import add_view, with_views
from tallyvane.operators import embedding as emb
from tallyvane.operators import retrieval as r
from tallyvane.operators import upsert

DIM = 64
LEVEL = 0.25  # cosine level that splits the given vectors

add_view("centroids", "", """
    SELECT label AS query_id, list(a ORDER BY i) AS q FROM (
      SELECT label, i, avg(e::DOUBLE) AS a FROM (
        SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
    GROUP BY label""")
add_view("phrases", "news", """
    SELECT row_number() OVER (ORDER BY query DESC) - 1 AS query_id, query
    FROM (SELECT DISTINCT split_part(title, ' Supplier#', 1) AS query FROM news)""")
add_view("sims", "vectors centroids", """
    SELECT query_id, id, entity_type, company_id, importance, published_at,
           list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM vectors, centroids""")
add_view("keyhits", "vectors phrases centroids", """
    SELECT query_id, id, entity_type, least(0.7::DOUBLE, hits / greatest(sqrt(length(content)), 1) * 10)::DOUBLE AS score
    FROM (SELECT query_id, id, entity_type, content,
                 len(list_filter(string_split(query, ' '), lambda t: length(t) > 2 AND contains(lower(content), t))) AS hits
          FROM vectors, phrases WHERE query_id IN (SELECT query_id FROM centroids)) WHERE hits > 0""")


def queries_of(m):
    """One query per label: the mean vector of the label and a headline phrase."""
    mean = (m.table("embeddings").select("label", F.posexplode("embedding").alias("i", "e"))
            .groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("a"))
            .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))),
                                              lambda s: s["a"]).alias("embedding")))
    phrase = m.news().select(F.substring_index("title", " Supplier#", 1).alias("query")).distinct()
    phrase = phrase.withColumn("query_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("query"))) - 1)
    return mean.select(F.col("label").alias("query_id"), "embedding").join(phrase, "query_id")


@query("vector_search", "K1 K2 H5", with_views("sims", f"""
    SELECT query_id, id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sims WHERE score > {LEVEL})
    WHERE rank <= 10"""))
def vector_search(m):
    out = r.similarity_search(m.vectors().select("id", "embedding"), queries_of(m), DIM, LEVEL, 10)
    return out.select("query_id", "id", *rnd("score"), "rank")


@query("vector_matches_in_blocks", "K1", with_views("sims", f"""
    SELECT query_id, id, round(score, 6) AS score FROM sims WHERE score > {LEVEL}"""))
def vector_matches_in_blocks(m):
    """All matches, the queries in several blocks."""
    out = r.similarity_pairs(m.vectors().select("id", "embedding"), queries_of(m), DIM, LEVEL, block=8)
    return out.select("query_id", "id", *rnd("score"))


@query("filtered_vector_search", "K3", with_views("sims facts", f"""
    SELECT query_id, id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sims, facts
      WHERE score > 0 AND entity_type IN ('news', 'event') AND coalesce(importance, 0) >= 0.3
        AND published_at >= as_of - INTERVAL 15 DAY AND published_at <= as_of - INTERVAL 1 DAY)
    WHERE rank <= 5"""))
def filtered_vector_search(m):
    from datetime import timedelta

    f = r.Filters(("news", "event"), minimum={"importance": 0.3}, date_from=m.as_of - timedelta(days=15),
                  date_to=m.as_of - timedelta(days=1))
    out = r.similarity_search(m.vectors().drop("content"), queries_of(m), DIM, 0.0, 5, f)
    return out.select("query_id", "id", *rnd("score"), "rank")


@query("keyword_search", "K4", with_views("keyhits", """
    SELECT query_id, id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM keyhits) WHERE rank <= 10"""))
def keyword_search(m):
    out = r.rank_hits(r.keyword_pairs(m.vectors(), queries_of(m), 10), 10)
    return out.select("query_id", "id", *rnd("score"), "rank")


_HYBRID = """
    SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY list_no) AS keep FROM (
      SELECT query_id, id, score, 0 AS list_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k
        FROM sims WHERE score > {level} {where}) WHERE k <= {depth}
      UNION ALL
      SELECT query_id, id, score, 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k
        FROM keyhits WHERE true {where}) WHERE k <= {limit})) WHERE keep = 1"""


@query("hybrid_search", "K5 H6 H7", with_views("sims keyhits", f"""
    SELECT query_id, id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM ({_HYBRID.format(level=LEVEL, where="", depth=20, limit=10)})) WHERE rank <= 10"""))
def hybrid_search(m):
    out = r.hybrid_search(m.vectors(), queries_of(m), DIM, 10, LEVEL)
    return out.select("query_id", "id", *rnd("score"), "rank")


@query("merged_by_score", "H7", with_views("sims keyhits", f"""
    SELECT query_id, id, round(max(score), 6) AS score FROM (
      SELECT query_id, id, score FROM sims WHERE score > {LEVEL} UNION ALL SELECT query_id, id, score FROM keyhits) GROUP BY ALL"""))
def merged_by_score(m):
    q = queries_of(m)
    cols = ["query_id", "id", "score"]
    lists = [r.similarity_pairs(m.vectors().select("id", "embedding"), q, DIM, LEVEL).select(*cols),
             r.keyword_pairs(m.vectors(), q).select(*cols)]
    return r.merge_hits(lists, prefer_earlier=False).select("query_id", "id", *rnd("score"))


_TOP = """SELECT '{bucket}' AS bucket, query_id, id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({src})) WHERE rank <= {limit}"""


@query("context_buckets", "K6 C24", with_views("sims keyhits", " UNION ALL ".join([
    _TOP.format(bucket="news", limit=5, src=_HYBRID.format(level=LEVEL, where="AND entity_type = 'news'", depth=10, limit=5)),
    _TOP.format(bucket="events", limit=5, src=f"SELECT * FROM sims WHERE score > {LEVEL} AND entity_type = 'event'"),
    _TOP.format(bucket="previous_analyses", limit=3, src=f"SELECT * FROM sims WHERE score > {LEVEL} AND entity_type = 'analysis'")])))
def context_buckets(m):
    """Filings are excluded by the inclusion flag; they would be empty anyway."""
    levels = {b: LEVEL for b in r.BUCKETS}
    out = r.retrieve_context(m.vectors(), queries_of(m), DIM,
                             r.excluded_buckets(include_fundamentals=False), levels)
    return out.select("bucket", "query_id", "id", *rnd("score"), "rank")


@query("ticker_search", "K7", with_views("sims companies phrases", """
    SELECT query_id, ticker, id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM sims JOIN companies USING (company_id) JOIN phrases USING (query_id)
      WHERE company_id = query_id % (SELECT count(*) FROM supplier)
        AND score > CASE WHEN contains(upper(query), 'V') THEN 0.75 ELSE -0.2 END) WHERE rank <= 10"""))
def ticker_search(m):
    q = queries_of(m).withColumn("ticker", F.concat(
        F.lit(" s"), (F.col("query_id") % m.n_companies).cast("string")))
    out = r.retrieve_by_ticker(m.vectors(), q, m.companies(), DIM, base=-0.2)
    return out.select("query_id", "ticker", "id", *rnd("score"), "rank")


@query("dynamic_thresholds", "K7", """
    SELECT item_id, CASE WHEN item_id % 3 = 0 OR contains(lower(text), ' ticker ')
                           OR len(list_filter(['AAPL', 'MSFT', 'GOOGL', 'AMZN', 'TSLA', 'META', 'NVDA', 'JPM', 'V', 'WMT'], lambda t: contains(upper(text), t))) > 0
                         THEN 0.75 WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) > 10
                         THEN 0.6 ELSE 0.7 END::DOUBLE AS threshold
    FROM benchmark""")
def dynamic_thresholds(m):
    """Benchmark texts as queries; every third one asks for a ticker."""
    q = m.table("benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("ticker: "), F.col("text")))
                                    .otherwise(F.col("text")).alias("q"))
    return q.select("item_id", r.dynamic_threshold("q", 0.7).alias("threshold"))


@query("vector_intake", "B13", """
    SELECT doc_id AS item, CASE WHEN doc_id % 5 = 0 THEN 'blank content' WHEN doc_id % 7 = 0 THEN 'empty vector'
             WHEN doc_id % 11 = 0 THEN 'wrong dimension' ELSE 'stored' END AS outcome
    FROM documents JOIN embeddings ON vec_id = doc_id""")
def vector_intake(m):
    rows = m.table("embeddings").join(m.table("documents"), F.col("vec_id") == F.col("doc_id")).select(
        F.col("doc_id").alias("item"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.col("text")).alias("content"),
        F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<float>"))
        .when(F.col("doc_id") % 11 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("embedding"))
    stored, bad = upsert.split_vectors(rows, DIM)
    return stored.select("item", F.lit("stored").alias("outcome")).unionByName(
        bad.select("item", F.col("reason").alias("outcome")))


@query("not_yet_embedded", "B14 E12", with_views("vectors", """
    SELECT doc_id AS item_id FROM documents
    WHERE doc_id NOT IN (SELECT entity_id FROM vectors WHERE entity_type = 'news')"""))
def not_yet_embedded(m):
    items = m.table("documents").select(F.col("doc_id").alias("item_id"))
    return upsert.not_yet_embedded(items, m.vectors(), "news")


@query("embedding_metadata", "C25", with_views("vectors", """
    SELECT id, concat_ws(';', 'company_id=' || company_id, 'entity_id=' || id, 'entity_type=' || entity_type,
                         'importance=' || importance, 'source=' || source) AS metadata FROM vectors"""))
def embedding_metadata(m):
    meta = r.metadata_map(entity_type="entity_type", entity_id="entity_id", company_id="company_id", source="source",
                          importance="importance")
    flat = F.array_sort(F.transform(F.map_entries(meta), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return m.vectors().select("id", F.array_join(flat, ";").alias("metadata"))


@query("embedding_texts", "C26", with_views("news events_raw", """
    SELECT 'news' AS kind, news_id AS id, md5(trim(CASE WHEN news_id % 3 = 0 THEN title ELSE summary END)) AS digest FROM news
    UNION ALL SELECT 'event', news_id, md5(event_type || ': ' || description) FROM events_raw
    UNION ALL SELECT 'analysis', conv_id * 100 + turn, md5(CASE WHEN turn % 2 = 0 THEN 'turn ' || turn ELSE '{"turn":' || turn || '}' END) FROM conversations"""))
def embedding_texts(m):
    from tallyvane.operators import events as ev

    n = m.news().withColumn("content", F.lit(None).cast("string")).withColumn(
        "summary", F.when(F.col("news_id") % 3 != 0, F.col("summary")))
    news = n.select(F.lit("news").alias("kind"), F.col("news_id").alias("id"), emb.news_text().alias("t"))
    links = m.company_news().filter("relevance >= 0.8").select("news_id")
    e = ev.classify_news(m.news()).filter("event_type <> 'OTHER'").join(links, "news_id").filter(
        F.col("published_at") >= m.days_ago(170)).withColumn("description", F.col("title"))
    event = e.select(F.lit("event").alias("kind"), F.col("news_id").alias("id"), emb.event_text().alias("t"))
    rec = F.parse_json(F.to_json(F.when(F.col("turn") % 2 == 0, F.struct(
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("summary"), F.lit(None).cast("bigint").alias("turn")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("summary"), F.col("turn").alias("turn")))))
    an = m.table("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), rec.alias("llm_analysis"))
    analysis = an.select(F.lit("analysis").alias("kind"), "id", emb.analysis_text().alias("t"))
    return news.unionByName(event).unionByName(analysis).select("kind", "id", F.md5("t").alias("digest"))


@query("embedded_documents", "K8", f"""
    SELECT doc_id, {DIM} AS dims, 1.0::DOUBLE AS norm FROM documents""")
def embedded_documents(m):
    """Whole documents through the offline encoder in Arrow batches."""
    out = emb.embed(m.table("documents").select("doc_id", "text"), "text", emb.hashing_encoder(DIM))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("doc_id", F.size("embedding").alias("dims"), F.round(F.sqrt(norm), 6).alias("norm"))
