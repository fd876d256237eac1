"""Exact vector search, keyword search and their hybrid, for batches of queries of any size.

Queries are fetched in blocks of a fixed number of rows and each block travels with
the tasks through one pass over the documents: vectors meet in one matrix product per
Arrow batch, texts in one substring test per distinct term. Documents are never
shuffled, so no company or query is a hot key. With a result limit, a batch keeps only
each query's best rows (and ties) before anything is shuffled. The hits of a block are
written before the next one is fetched: driver and tasks hold one block at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyvane.operators.latest import top_per_key
from tallyvane.operators.materialize import shared_folder

BLOCK = 1024  # queries per pass over the documents
#: Rows of a batch scored at once: with a block of queries about 16 MB of scores, whatever the batch size.
SLICE = 2000


@dataclass(frozen=True)
class Filters:
    """Constraints on entity type, typed metadata columns and publication time."""

    entity_types: tuple[str, ...] = ()
    equals: dict[str, object] = field(default_factory=dict)
    minimum: dict[str, float] = field(default_factory=dict)
    date_from: dt.datetime | None = None
    date_to: dt.datetime | None = None
    date_field: str = "published_at"

    def condition(self) -> Column:
        """Types are alternatives; a missing minimum field counts as 0; dates compare as ISO text."""
        out = F.lit(True)
        if self.entity_types:
            out = out & F.col("entity_type").isin(*self.entity_types)
        for key, value in self.equals.items():
            out = out & (F.col(key).cast("string") == str(value))
        for key, low in self.minimum.items():
            out = out & (F.coalesce(F.col(key).cast("double"), F.lit(0.0)) >= low)
        iso = F.date_format(self.date_field, "yyyy-MM-dd'T'HH:mm:ss")
        if self.date_from is not None:
            out = out & (iso >= self.date_from.isoformat())
        if self.date_to is not None:
            out = out & (iso <= self.date_to.isoformat())
        return out


def metadata_map(*, entity_type, entity_id, **optional) -> Column:
    """Metadata as MAP<STRING, STRING> without NULL or empty entries."""
    pairs = {"entity_type": entity_type, "entity_id": entity_id, **optional}
    full = F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), F.col(c).cast("string"))])
    return F.map_filter(full, lambda k, v: v.isNotNull() & (v != ""))


def checked_vector(vector, dim: int) -> Column:
    """The vector, or an error that names both dimensions."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.format_string(
        "query embedding has %d dimensions, %d expected", F.size(v), F.lit(dim))).cast("array<double>"))


def _unit(v) -> Column:
    """Vector of doubles scaled to length 1 (NULL for a zero vector)."""
    d = F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm))


def _passes(docs: DataFrame, queries: DataFrame, keep: list[str], block: int, scorer: Callable) -> DataFrame:
    """Hits (``keep``, query_id, score) of every block of queries; ``scorer(rows)`` makes the function for the batches."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("score", T.DoubleType())])
    rows = queries.toLocalIterator()
    now, after = list(islice(rows, block)), list(islice(rows, block))
    if not after:
        return docs.mapInArrow(scorer(now), schema)
    # one table for all blocks: its plan is a single scan, whatever the number of queries
    spark, number = docs.sparkSession, 0
    path = f"{shared_folder(spark)}/search-hits-{uuid.uuid4().hex}"
    while now:
        docs.mapInArrow(scorer(now), schema).write.parquet(f"{path}/block={number}")
        now, after, number = after, list(islice(rows, block)), number + 1
    return spark.read.schema(schema).parquet(path)


def _emitter(keep: list[str], ids: list, id_type: T.DataType, best: int | None) -> Callable:
    """Function from a batch and its scores (rows x queries, NaN for no hit) to the batch of hits.

    It and the scorers import what they need: they travel to workers that lack this package.
    """
    kind = to_arrow_type(id_type)

    def emit(batch, scores):
        import numpy as np
        import pyarrow as pa

        if best is not None and len(scores) > best:
            ranked = np.where(np.isnan(scores), -np.inf, scores)
            least = np.partition(ranked, len(ranked) - best, axis=0)[len(ranked) - best]
            scores = np.where(ranked >= least, scores, np.nan)
        row, query = np.nonzero(~np.isnan(scores))
        found = batch.select(keep).take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [*found.columns, pa.array([ids[i] for i in query.tolist()], kind), pa.array(scores[row, query], pa.float64())],
            names=[*keep, "query_id", "score"])

    return emit


def similarity_pairs(docs: DataFrame, queries: DataFrame, dim: int, threshold=None, best: int | None = None,
                     match: str | None = None, block: int = BLOCK) -> DataFrame:
    """(docs columns, query_id, score) of all pairs with cosine strictly above the threshold.

    ``queries``: query_id, embedding, and ``threshold`` when none is given as a number.
    ``match`` names a column whose values must be equal on both sides. With ``best``
    only rows that can be among a query's best so many are sure to be returned.
    Vectors that are null, zero or of another dimension match nothing.
    """
    th = F.col("threshold") if threshold is None else F.lit(float(threshold))
    group = F.col(match) if match else F.lit(0)
    q = queries.select("query_id", _unit(checked_vector("embedding", dim)).alias("u"), th.cast("double").alias("th"), group.alias("g"))
    keep = [c for c in docs.columns if c != "embedding"]

    def scorer(rows: list) -> Callable:
        rows = [r for r in rows if r["u"] is not None and r["th"] is not None and r["g"] is not None]
        slice_rows = SLICE
        flat, levels, groups = [r["u"] for r in rows], [r["th"] for r in rows], [r["g"] for r in rows]
        emit = _emitter(keep, [r["query_id"] for r in rows], q.schema["query_id"].dataType, best)

        def run(batches: Iterator) -> Iterator:
            import numpy as np

            vectors, level, wanted = np.array(flat, float).reshape(-1, dim), np.array(levels, float), np.array(groups)
            for batch in batches:
                if not batch.num_rows or not len(vectors):
                    continue
                for at in range(0, batch.num_rows, slice_rows):
                    part = batch.slice(at, slice_rows)
                    d = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        scores = d / np.sqrt((d * d).sum(axis=1, keepdims=True)) @ vectors.T
                    hit = scores > level
                    if match:
                        hit &= part.column(match).to_numpy(zero_copy_only=False)[:, None] == wanted
                    scores[~hit] = np.nan
                    yield emit(part, scores)

        return run

    return _passes(docs.filter(F.size("embedding") == dim), q, keep, block, scorer)


def rank_hits(hits: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` documents per query, ties by id; group-limited before the shuffle."""
    return top_per_key(hits, ["query_id"], [F.desc("score"), F.asc("id")], limit, rank_col="rank")


def similarity_search(docs: DataFrame, queries: DataFrame, dim: int, threshold=0.7, limit: int = 10,
                      filters: Filters | None = None) -> DataFrame:
    docs = docs.filter(filters.condition()) if filters else docs
    return rank_hits(similarity_pairs(docs, queries, dim, threshold, limit), limit)


def keyword_pairs(docs: DataFrame, queries: DataFrame, best: int | None = None, filters: Filters | None = None,
                  block: int = BLOCK) -> DataFrame:
    """(docs columns, query_id, score) of documents that contain a term of the query.

    Score = min(10 * hit terms / sqrt(length), 0.7); queries without a term of
    three letters or more look for the whole text and score 0.5. Null texts match nothing.
    """
    docs = docs.filter(filters.condition()) if filters else docs
    low = F.lower("query")
    terms = F.filter(F.split(low, r"\s+"), lambda t: F.length(t) > 2)
    q = queries.select("query_id", low.alias("text"), terms.alias("terms"))
    keep = [c for c in docs.columns if c not in ("embedding", "content")]
    scale = F.greatest(F.sqrt(F.length("content").cast("double")), F.lit(1.0))
    base = docs.filter("content IS NOT NULL").select(*keep, F.lower("content").alias("_low"), scale.alias("_scale"))

    def scorer(rows: list) -> Callable:
        slice_rows = SLICE
        asked = [(r["terms"] or [r["text"]], bool(r["terms"])) for r in rows if r["text"] is not None]
        emit = _emitter(keep, [r["query_id"] for r in rows if r["text"] is not None], q.schema["query_id"].dataType, best)

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow.compute as pc

            for batch in batches:
                for at in range(0, batch.num_rows if asked else 0, slice_rows):
                    part = batch.slice(at, slice_rows)
                    scale = part.column("_scale").to_numpy()
                    holds = {t: pc.match_substring(part.column("_low"), t).to_numpy(zero_copy_only=False)
                             for t in {t for ts, _ in asked for t in ts}}
                    scores = np.empty((part.num_rows, len(asked)))
                    for i, (ts, scaled) in enumerate(asked):
                        n = np.zeros(part.num_rows, np.int32)
                        for t in ts:
                            n += holds[t]
                        scores[:, i] = np.minimum(n / scale * 10.0, 0.7) if scaled else n * 0.5
                    scores[scores <= 0] = np.nan
                    yield emit(part, scores)

        return run

    return _passes(base, q, keep, block, scorer)


def merge_hits(lists: list[DataFrame], prefer_earlier: bool = True) -> DataFrame:
    """Union by (query_id, id): the earlier list wins, or the higher score."""
    rows = None
    for i, df in enumerate(lists):
        part = df.withColumn("_list", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    order = [F.asc("_list"), F.desc("score")] if prefer_earlier else [F.desc("score"), F.asc("_list")]
    return top_per_key(rows, ["query_id", "id"], order).drop("_list")


def hybrid_search(docs: DataFrame, queries: DataFrame, dim: int, limit: int = 10, threshold=0.5,
                  filters: Filters | None = None) -> DataFrame:
    """Semantic hits at twice the depth, then keyword hits; semantic wins on the same document."""
    cols = ["id", "query_id", "score"]
    semantic = similarity_search(docs, queries, dim, threshold, limit * 2, filters).select(*cols)
    keyword = rank_hits(keyword_pairs(docs, queries, limit, filters), limit).select(*cols)
    return rank_hits(merge_hits([semantic, keyword]), limit)


# fixed values: retrieval buckets: name -> (entity type, limit, threshold, hybrid)
BUCKETS = {
    "news": ("news", 5, 0.5, True),
    "filings": ("sec_filing", 3, 0.7, False),
    "events": ("event", 5, 0.7, False),
    "previous_analyses": ("analysis", 3, 0.7, False),
}


def retrieve_context(docs: DataFrame, queries: DataFrame, dim: int, exclude=frozenset(),
                     thresholds: dict[str, float] | None = None) -> DataFrame:
    """Bucketed results (bucket, query_id, id, score, rank); excluded buckets are left out."""
    out = None
    for bucket, (kind, limit, th, hybrid) in BUCKETS.items():
        if bucket in exclude:
            continue
        th = (thresholds or {}).get(bucket, th)
        search = hybrid_search if hybrid else similarity_search
        hits = search(docs, queries, dim, limit=limit, threshold=th, filters=Filters((kind,)))
        part = hits.select(F.lit(bucket).alias("bucket"), "query_id", "id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def excluded_buckets(include_news: bool = True, include_fundamentals: bool = True) -> frozenset[str]:
    out: set[str] = set()
    if not include_news:
        out |= {"news", "events"}
    if not include_fundamentals:
        out.add("filings")
    return frozenset(out)


# fixed values: tickers that make a query ticker-centric
WELL_KNOWN_TICKERS = ("AAPL", "MSFT", "GOOGL", "AMZN", "TSLA", "META", "NVDA", "JPM", "V", "WMT")


def dynamic_threshold(query, base) -> Column:
    """At least 0.75 for ticker-centric queries, 0.1 lower (not below 0.5) for long ones."""
    q = F.col(query) if isinstance(query, str) else query
    b = F.lit(float(base)) if isinstance(base, (int, float)) else base
    up = F.upper(q)
    centric = F.contains(F.lower(q), F.lit(" ticker ")) | F.startswith(F.lower(q), F.lit("ticker:"))
    for t in WELL_KNOWN_TICKERS:
        centric = centric | F.contains(up, F.lit(t))
    long = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) > 10
    return (F.when(centric, F.greatest(b, F.lit(0.75)))
            .when(long, F.greatest(F.bround(b - 0.1, 10), F.lit(0.5))).otherwise(b))


def retrieve_by_ticker(docs: DataFrame, queries: DataFrame, companies: DataFrame, dim: int,
                       base: float = 0.7, limit: int = 10) -> DataFrame:
    """Per query only its company's documents, at the query's own threshold, tagged with the ticker."""
    q = (queries.withColumn("ticker", F.upper(F.trim("ticker")))
         .join(companies.select("ticker", "company_id"), "ticker")
         .select("query_id", "ticker", "company_id", "embedding", dynamic_threshold("query", base).alias("threshold")))
    hits = similarity_pairs(docs.select("id", "company_id", "embedding"), q, dim, best=limit, match="company_id")
    return rank_hits(hits.drop("company_id"), limit).join(q.select("query_id", "ticker"), "query_id").select(
        "id", "query_id", "ticker", "score", "rank")


def bucket_counts(context: DataFrame, queries: DataFrame) -> DataFrame:
    """Retrieved items per query: one count per bucket and their total; a query without any has zeros.

    ``context`` as from ``retrieve_context``.
    """
    counts = context.groupBy("query_id").agg(*[F.count_if(F.col("bucket") == b).alias(f"{b}_count") for b in BUCKETS],
                                             F.count(F.lit(1)).alias("total_retrieved"))
    names = [f"{b}_count" for b in BUCKETS] + ["total_retrieved"]
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def entity_counts(docs: DataFrame, text: str) -> DataFrame:
    """(entity_type, n) of embedded rows whose content holds the text in any case."""
    held = F.contains(F.upper("content"), F.lit(text.upper()))
    return docs.filter(held).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
