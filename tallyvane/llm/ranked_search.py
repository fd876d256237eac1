"""Ranked lexical search with range-maximum tables over posting lists.

Documents become short vectors over the terms of the items: one pass over the texts
writes (doc_id, length, terms, frequencies). Global figures (documents, their terms,
document frequencies) are Spark aggregates over those vectors. Each task then cuts its
vectors into index parts of bounded size. In a part every posting list has a sparse
table of range maxima; an item's search starts with the interval of all documents,
always takes the intervals with the highest bounds, scores the document of the
largest single impact exactly and splits the interval there. The bound of an interval
is the sum of the lists' maxima inside it, so an interval below the item's k-th
score holds no result. Each part hands its k best to the next one as a threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.llm import buffers
from tallyvane.operators.materialize import stored

#: Bytes that separate terms: ASCII without letters and digits.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = True
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

#: Bytes of item text searched in one pass, and postings of one index part.
BLOCK_BYTES = 4_000_000
PART_POSTINGS = 600_000
#: Intervals that an item splits per round.
WIDTH = 4


def terms_of(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per piece of the column: its first row, the hash of every term and the first term of each text (one more at the end)."""
    for piece in buffers.pieces(texts):
        begin, end, first = buffers.words(piece, buffers.LOWER, SEPARATOR)
        yield piece.first, buffers.word_hashes(piece, begin, end, buffers.LOWER), first


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each comes."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.r_[at, len(keys)])


@dataclass
class Items:
    """Items as rows of (term, times); terms number the sorted distinct hashes."""

    vocabulary: np.ndarray
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> "Items":
        found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for row, hashes, first in terms_of(pa.array(texts, pa.string())):
            found.append(hashes)
            owner.append(row + np.repeat(np.arange(len(first) - 1), np.diff(first)))
        vocabulary, number = np.unique(np.concatenate(found), return_inverse=True)
        size = max(1, len(vocabulary))
        pair, times = runs(np.sort(np.concatenate(owner) * size + number))
        return cls(vocabulary, np.searchsorted(pair // size, np.arange(len(texts) + 1)), pair % size, times)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term number of each hash, and whether the vocabulary has it."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return at, (self.vocabulary[at] == hashes) if len(self.vocabulary) else np.zeros(len(hashes), bool)


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term; terms outside the items count in n only."""
    shipped = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value
        size = max(1, len(items.vocabulary))
        for batch in batches:
            for row, hashes, first in terms_of(batch.column("text")):
                n = np.diff(first)
                number, known = items.numbers(hashes)
                owner = np.repeat(np.arange(len(n)), n)[known]
                pair, tf = runs(np.sort(owner * size + number[known]))
                bounds = np.searchsorted(pair, np.arange(len(n) + 1) * size)
                kept = n > 0  # a text without a term has no pairs either
                bounds = np.r_[bounds[:-1][kept], bounds[-1]].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(n)).filter(pa.array(kept)), pa.array(n[kept], pa.int64()),
                     pa.ListArray.from_arrays(bounds, pa.array(pair % size, pa.int32())),
                     pa.ListArray.from_arrays(bounds, pa.array(tf, pa.int32()))],
                    names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, terms array<int>, tf array<int>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Part:
    """Posting lists of some documents, each with a sparse table of range maxima.

    All lists lie one behind the other in (term, document) order, so a list's range is
    a range of one sorted key array. ``top[j][p]`` is the place of the first maximum
    among the 2^j postings from p.
    """

    def __init__(self, n_docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        self.n_docs = n_docs
        self.key = term[order].astype(np.int64) * (n_docs + 1) + doc[order]
        self.doc, self.impact = doc[order], impact[order]
        longest = int(np.bincount(term).max(initial=0)) if len(term) else 0
        self.top = [np.arange(len(self.doc), dtype=np.int32)]
        for j in range(1, max(1, longest).bit_length()):
            half, last = 1 << (j - 1), self.top[-1]
            other = last[half:]
            mine = last[:len(other)]
            self.top.append(np.where(self.impact[other] > self.impact[mine], other, mine))
        self.width = np.array([len(t) for t in self.top])
        self.flat = np.concatenate(self.top)
        self.base = np.r_[0, np.cumsum(self.width)[:-1]]

    def at(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Place of the first posting of the term's list at or behind the document."""
        return np.searchsorted(self.key, term * (self.n_docs + 1) + doc)

    def maximum(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact and its document within places [first, last); 0 and 0 where there is none."""
        some = last > first
        level = np.frexp(np.maximum(last - first, 1).astype(float))[1] - 1
        a = self.flat[np.where(some, self.base[level] + first, 0)]
        b = self.flat[np.where(some, self.base[level] + last - (1 << level), 0)]
        best = np.where(self.impact[b] > self.impact[a], b, a)
        return np.where(some, self.impact[best], 0), np.where(some, self.doc[best], 0)


def spread(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start[r]:start[r + 1] of all given rows, and where each row begins among them."""
    size = start[rows + 1] - start[rows]
    begin = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(begin - start[rows], size), begin


def best_first(part: Part, items: Items, k: int, floor: np.ndarray, seen: dict | None = None) -> tuple[np.ndarray, ...]:
    """(item, document, score) of each item's k best documents of the part; equal scores by ascending document.

    ``floor`` holds a score per item that k documents outside the part reach already: only scores of
    at least that much are of interest. ``seen`` receives the number of scored documents.
    """
    n_items = len(items.start) - 1
    nothing = np.zeros(0, np.int64)
    found = (nothing, nothing, nothing)
    if not len(part.key):
        return found

    def bounds(owner, first, last, times, begin, total):
        value, doc = part.maximum(first, last)
        value = value * times
        bound = np.add.reduceat(value, begin)
        # the document of the largest single contribution
        top = np.maximum.reduceat(value, begin)
        hit = np.flatnonzero(value == np.repeat(top, total))
        return bound, doc[hit[np.searchsorted(hit, begin)]]

    item = np.flatnonzero(np.diff(items.start) > 0)
    lo, hi = np.zeros(len(item), np.int64), np.full(len(item), part.n_docs, np.int64)
    at, begin = spread(items.start, item)
    size = np.diff(np.r_[begin, len(at)])
    term, times = items.term[at], items.times[at]
    bound, split = (bounds(item, part.at(term, np.repeat(lo, size)), part.at(term, np.repeat(hi, size)), times, begin, size)
                    if len(item) else (nothing, nothing))
    least, least_doc = np.maximum(floor, 1), np.full(n_items, part.n_docs, np.int64)
    scored = 0
    while True:
        open_ = (bound > least[item]) | ((bound == least[item]) & (lo <= least_doc[item]))
        item, lo, hi, bound, split = (x[open_] for x in (item, lo, hi, bound, split))
        if not len(item):
            break
        order = np.lexsort((lo, -bound, item))
        item, lo, hi, bound, split = (x[order] for x in (item, lo, hi, bound, split))
        place = np.arange(len(item)) - np.searchsorted(item, item)
        now = place < WIDTH
        i, a, b, d = item[now], lo[now], hi[now], split[now]
        scored += len(i)
        at, begin = spread(items.start, i)
        size = np.diff(np.r_[begin, len(at)])
        term, times = items.term[at], items.times[at]
        first, last, mid = (part.at(term, np.repeat(x, size)) for x in (a, b, d))
        hit = (mid < last) & (part.doc[np.minimum(mid, len(part.doc) - 1)] == np.repeat(d, size))
        score = np.add.reduceat(np.where(hit, part.impact[np.minimum(mid, len(part.doc) - 1)], 0) * times, begin)
        found = tuple(np.concatenate(x) for x in zip(found, (i, d, score)))
        order = np.lexsort((found[1], -found[2], found[0]))
        found = tuple(x[order] for x in found)
        place = np.arange(len(order)) - np.searchsorted(found[0], found[0])
        found = tuple(x[place < k] for x in found)
        full = np.flatnonzero(place[place < k] == k - 1)
        better = found[2][full] >= least[found[0][full]]
        least[found[0][full][better]] = found[2][full][better]
        least_doc[found[0][full][better]] = found[1][full][better]
        left, right = bounds(i, first, mid, times, begin, size), bounds(i, mid + hit, last, times, begin, size)
        item, lo, hi, bound, split = (np.concatenate(x) for x in (
            (item[~now], i, i), (lo[~now], a, d + 1), (hi[~now], d, b), (bound[~now], left[0], right[0]),
            (split[~now], left[1], right[1])))
    if seen is not None:
        seen["scored"] = seen.get("scored", 0) + scored
    good = found[2] >= np.maximum(floor, 1)[found[0]]
    return tuple(x[good] for x in found)


def _best_of_tasks(vectors: DataFrame, items: Items, weight: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """Each task's candidates (item, doc_id, score): k for every item, more only where ties of ids may matter."""
    shipped = vectors.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shipped.value
        n_items = len(items.start) - 1
        best = tuple(np.zeros(0, np.int64) for _ in range(4))  # item, score, id is null, id

        def search(rows: list[pa.RecordBatch], best):
            table = pa.Table.from_batches(rows).combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            void = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            name = ids.fill_null(0).to_numpy()
            terms, tf = table.column("terms").combine_chunks(), table.column("tf").combine_chunks()
            held = np.diff(terms.offsets.to_numpy())
            order = np.lexsort((name, void))  # documents by id, null ids last
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            m = 25 + (75 * table.column("n").to_numpy() * n_docs) // length
            term, count = terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
            impact = weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * np.repeat(m, held)))
            useful = impact > 0
            floor = np.zeros(n_items, np.int64)
            full = np.flatnonzero(np.bincount(best[0], minlength=n_items) >= k)
            if len(full):
                floor[full] = best[1][np.searchsorted(best[0], full) + k - 1]
            part = Part(len(order), term[useful], np.repeat(rank, held)[useful], impact[useful])
            item, doc, score = best_first(part, items, k, floor)
            new = item, score, void[order][doc], name[order][doc]
            item, score, void, name = (np.concatenate(x) for x in zip(best, new))
            order = np.lexsort((name, void, -score, item))
            item, score, void, name = (x[order] for x in (item, score, void, name))
            kept = np.arange(len(item)) - np.searchsorted(item, item) < k
            return tuple(x[kept] for x in (item, score, void, name))

        rows, postings = [], 0
        for batch in batches:
            rows.append(batch)
            postings += len(batch.column("terms").flatten()) + batch.num_rows
            if postings > PART_POSTINGS:
                best, rows, postings = search(rows, best), [], 0
        if rows:
            best = search(rows, best)
        item, score, void, name = best
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(name, pa.int64(), mask=void.astype(bool)),
                                          pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Equal scores come by ascending doc_id, null ids last; every row of ``docs`` is a document, so a
    repeated row takes a rank of its own. Repeated rows of ``items`` are answered once; two texts under one id
    are two items. A document or item without a term (null, empty, only punctuation) has no part in anything; items
    without a scoring document give no row, and empty tables an empty result. Texts of any length count
    whole. Other columns are ignored. Items go in blocks of about ``BLOCK_BYTES`` of text, one pass over the texts each.
    """
    spark = docs.sparkSession
    asked = stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct(),
                   "search-items")
    bytes_ = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-bytes_ // BLOCK_BYTES))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    answers = None
    for block in range(n_blocks):
        rows = asked.where(block_of == block).orderBy("item_id", "text").collect()
        part = Items.of([r["text"] for r in rows])
        found = stored(vectors(docs, part), "search-vectors")
        total = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        weight = np.zeros(max(1, len(part.vocabulary)), np.int64)
        for term, df in zip(held.column("term").to_pylist(), held.column("df").to_pylist()):
            weight[term] = term_weight(total["docs"], df)
        near = _best_of_tasks(found, part, weight, total["docs"], total["terms"] or 1, k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item bigint, item_id bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = stored(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-answers")
        answers = top if answers is None else answers.unionByName(top)
    return answers
