"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over all their words and word beginnings; document
frequencies come from the whole corpus. A bounded sample of examples forms a
block-max inverted index that travels with the tasks: similar examples share a
block, a frequent term keeps its greatest weight in each block, and a block is scored
only if the sum of those maxima and of the best sum of rarer terms in it can reach the
k-th best cosine found so far. The k nearest are exact. A neighbour's vote weighs as much of its cosine as comes from terms that
positive examples hold more often than others. Votes are mapped to a probability by
isotonic regression on further labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.common import unit
from tallyvane.operators.materialize import stored

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 5)
BATCH = 128
#: Texts whose rare terms are summed at once: their postings fit a cache.
FEW = 16
BLOCK = 64
#: Blocks of greatest bound that are scored before others are tested against the k-th cosine.
WAVES = (2,)
#: Sums of weights below 1 in another order differ by far less.
SLACK = 1e-9
DENSE_TERMS = 2048
MEMO = 400_000


def word_features(word: str) -> list[str]:
    """``=word`` and each ``beginning*`` of a run of letters."""
    return ["=" + word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


def features(token: str) -> set[str]:
    """The features of each run of letters in a lower-cased token."""
    return {f for word in LETTERS.findall(token) for f in word_features(word)}


@cache
def letter_table() -> np.ndarray:
    """For every code point, whether it belongs to a run of letters."""
    points = np.zeros(0x110000, bool)
    for start in (0, 0xE000):  # without surrogates, which no text holds
        for run in LETTERS.finditer("".join(map(chr, range(start, 0xD800 if not start else 0x110000)))):
            points[start + run.start():start + run.end()] = True
    return points


def words_of(text: str | None) -> list[str]:
    """The runs of letters of the lower-cased text, as ``LETTERS`` finds them."""
    if not text:
        return []
    raw = bytearray(text.lower(), "utf-32-le")
    points = np.frombuffer(raw, np.uint32)
    points[~letter_table()[points]] = 32
    return str(raw, "utf-32-le").split()


class Numbered(dict):
    """Words by the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Vectorizer:
    """Term counts of a text; the features of a word are remembered within a bound.

    Terms are the ids of a vocabulary, and negative numbers for terms outside it.
    """

    NONE = np.iinfo(np.int64).max

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.numbers, self.filled, self.rows = Numbered(), 0, np.zeros((4096, 1 + len(BEGINNINGS)), np.int64)

    def learn(self) -> None:
        """Fill the rows of words that have a number and no terms yet."""
        known, total = self.vocabulary, len(self.numbers)
        new = []
        for word in reversed(list(islice(reversed(self.numbers), total - self.filled))):
            terms = [known[f] if f in known else ~(hash(f) & (2 ** 62 - 1)) for f in word_features(word)]
            new += terms + [self.NONE] * (self.rows.shape[1] - len(terms))
        if total > len(self.rows):
            more = np.zeros((max(total, 2 * len(self.rows)), self.rows.shape[1]), np.int64)
            more[:self.filled] = self.rows[:self.filled]
            self.rows = more
        self.rows[self.filled:total] = np.array(new, np.int64).reshape(-1, self.rows.shape[1])
        self.filled = total

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted terms and how often each occurs."""
        words = words_of(text)
        if self.filled > MEMO:
            self.forget()
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > self.filled:
            self.learn()
        terms = np.sort(self.rows[at], axis=None)
        terms = terms[:np.searchsorted(terms, self.NONE)]
        new = np.ones(len(terms) + 1, bool)
        np.not_equal(terms[1:], terms[:-1], out=new[1:-1])
        first = np.flatnonzero(new)
        return terms[first[:-1]], first[1:] - first[:-1]

    def __call__(self, text: str | None) -> dict[int, int]:
        terms, counts = self.counted(text)
        return dict(zip(terms.tolist(), counts.tolist()))


def similar_order(vectors: np.ndarray, block: int) -> np.ndarray:
    """An order in which similar rows are near: halves along the main direction of each part, down to a block."""
    out, waiting = [], [np.arange(len(vectors))]
    while waiting:
        part = waiting.pop()
        if len(part) <= block:
            out.append(part)
            continue
        spread = vectors[part] - vectors[part].mean(0)
        along = spread[0] + 0.1
        for _ in range(8):
            along = spread.T @ (spread @ along)
            along /= np.linalg.norm(along) + 1e-12
        part = part[np.argsort(spread @ along, kind="stable")]
        middle = max(1, len(part) // (2 * block)) * block
        waiting += [part[middle:], part[:middle]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def ranges(first: np.ndarray, held: np.ndarray) -> np.ndarray:
    """All positions of the ranges that begin at ``first`` and hold ``held`` places."""
    return np.repeat(first - np.cumsum(held) + held, held) + np.arange(held.sum())


#: Occurrences by term, or sorted terms and their occurrences.
Counts = dict[int, int] | tuple[np.ndarray, np.ndarray]


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples in blocks; ``idf`` is the weight of each term, ``unseen`` of any other.

    The order of the examples as given settles ties. ``marked`` is the share of each
    term's part of a cosine that counts in votes.
    """

    n_terms: int
    idf: np.ndarray
    labels: np.ndarray
    names: list
    unseen: float = 1.0
    marked: np.ndarray | None = None
    post_id: np.ndarray = field(init=False)
    post_count: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    slot: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    made: dict | None = field(init=False, default=None)
    blocks_met: int = field(init=False, default=0)
    blocks_scored: int = field(init=False, default=0)

    def unit_vector(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        """Sorted term ids and weights; terms outside the vocabulary (negative) only shorten the others."""
        if isinstance(counts, dict):
            terms, times = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
            order = np.argsort(terms)
            terms, times = terms[order], times[order]
        else:
            terms, times = counts
        weight, known = 1 + np.log(times), np.searchsorted(terms, 0)
        other = weight[:known] * self.unseen
        terms = terms[known:]
        weight = weight[known:] * self.idf[terms]
        size = math.sqrt(float(weight @ weight) + float(other @ other))
        return terms, weight / size if size else weight

    def fill(self, examples: Iterable[dict[int, int]]) -> "BlockMaxIndex":
        terms, counts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
        for example in examples:
            terms.append(np.fromiter(example, np.int32, len(example)))
            counts.append(np.fromiter(example.values(), np.int32, len(example)))
            weight = (1 + np.log(counts[-1])) * self.idf[terms[-1]]
            sizes.append(math.sqrt(float(weight @ weight)) or 1.0)
        owner = np.repeat(np.arange(len(sizes)), [len(t) for t in terms[1:]]).astype(np.int64)
        flat, times = np.concatenate(terms), np.concatenate(counts)
        held = np.bincount(flat, minlength=self.n_terms)
        common = np.argsort(-held, kind="stable")[:DENSE_TERMS]
        self.slot = np.full(self.n_terms, -1, np.int32)
        self.slot[common] = np.arange(len(common))
        often = self.slot[flat] >= 0
        sketch = np.zeros((len(sizes), len(common)), np.float32)
        sketch[owner[often], self.slot[flat[often]]] = ((1 + np.log(times)) * self.idf[flat])[often] / np.array(sizes)[owner[often]]
        self.place = similar_order(sketch, BLOCK)  # the example at each place
        at = np.argsort(self.place)[owner]
        order = np.lexsort((at, flat))
        self.size = np.array(sizes)[self.place]
        self.post_id = at[order].astype(np.min_scalar_type(len(sizes)))
        self.post_count = times.astype(np.min_scalar_type(times.max(initial=0)))[order]
        self.start = np.concatenate([[0], np.cumsum(held)])
        return self

    def prepared(self) -> dict:
        """Posting weights, and the most frequent terms of each block as a matrix; made where they are used."""
        if self.made is not None:
            return self.made
        n, block = len(self.labels), self.post_id.astype(np.int64) // BLOCK
        n_blocks, n_common = -(-n // BLOCK), int((self.slot >= 0).sum())
        term = np.repeat(np.arange(self.n_terms, dtype=np.int32), np.diff(self.start))
        post = (1 + np.log(self.post_count.astype(float))) * self.idf[term] / self.size[self.post_id]
        often = self.slot[term] >= 0
        # a block's matrix has a row for each frequent term that the block holds
        held, row = np.unique(block[often] * n_common + self.slot[term[often]], return_inverse=True)
        cells = np.zeros((len(held), BLOCK))
        cells[row, self.post_id[often] % BLOCK] = post[often]
        most = np.zeros((n_common, n_blocks))
        most[held % max(1, n_common), held // max(1, n_common)] = cells.max(1, initial=0.0)
        cuts = np.searchsorted(held, np.arange(1, n_blocks) * n_common)
        votes = post if self.marked is None else post * self.marked[term]
        # an example's own terms; its first one stays even without votes, so that none is empty
        use = votes > 0
        use[np.unique(self.post_id, return_index=True)[1]] = True
        use = np.flatnonzero(use)
        forward = use[np.argsort(self.post_id[use], kind="stable")]
        own = np.cumsum(np.bincount(self.post_id[use], minlength=n))[:-1]
        self.made = {
            "post": post, "most": most, "dense": np.split(cells, cuts), "held": np.split(held % max(1, n_common), cuts),
            "own_terms": np.split(term[forward], own), "own_votes": np.split(votes[forward], own), "scratch": np.zeros(self.n_terms)}
        return self.made

    def nearest_all(self, texts: list[Counts], k: int) -> list[list[tuple[int, float, float]]]:
        """For each text the k examples of greatest positive cosine, exact; equal cosines in example order.

        An entry is (example, cosine, the marked part of the cosine).
        """
        if not len(self.labels):
            return [[] for _ in texts]
        return [near for at in range(0, len(texts), BATCH) for near in self._nearest(texts[at:at + BATCH], k)]

    def _nearest(self, texts: list[Counts], k: int) -> list[list[tuple[int, float, float]]]:
        made, n_texts = self.prepared(), len(texts)
        dense, n_blocks = made["dense"], len(made["dense"])
        vectors = [self.unit_vector(counts) for counts in texts]
        terms, weight = (np.concatenate(x) for x in zip(*vectors))
        text = np.repeat(np.arange(n_texts), [len(t) for t, _ in vectors])
        slot = self.slot[terms]
        rare = slot < 0
        asked = np.zeros((len(made["most"]), n_texts))
        asked[slot[~rare], text[~rare]] = weight[~rare]
        terms, weight, text = terms[rare], weight[rare], text[rare]
        scores = np.zeros((n_texts, n_blocks, BLOCK))  # of rare terms; a block's frequent terms are added where they can matter
        for at in range(0, n_texts, FEW):
            some, few = slice(*np.searchsorted(text, (at, at + FEW))), scores[at:at + FEW]
            first = self.start[terms[some]]
            count = self.start[terms[some] + 1] - first
            where = ranges(first, count)
            cell = np.repeat((text[some] - at) * (n_blocks * BLOCK), count) + self.post_id[where]
            few += np.bincount(cell, made["post"][where] * np.repeat(weight[some], count), minlength=few.size).reshape(few.shape)
        bound = asked.T @ made["most"] + scores.max(2)
        left = bound > 0
        self.blocks_met += bound.size
        for many in (*WAVES, n_blocks):
            chosen = left
            if many < n_blocks:
                chosen = left & (bound >= np.partition(bound, n_blocks - many, axis=1)[:, n_blocks - many, None])
            self.blocks_scored += int(chosen.sum())
            for b in np.flatnonzero(chosen.any(0)).tolist():
                who = np.flatnonzero(chosen[:, b])
                scores[who, b] += asked.take(made["held"][b], 0).take(who, 1).T @ dense[b]
            flat = scores.reshape(n_texts, -1)
            least = np.partition(flat, -k, axis=1)[:, -k] if k < flat.shape[1] else np.zeros(n_texts)
            left = left & ~chosen & (bound >= least[:, None] - SLACK)
            if not left.any():
                break
        out, scratch = [], made["scratch"]
        for row, limit, (terms, weight) in zip(flat, least, vectors):
            found = np.flatnonzero((row >= limit - SLACK) & (row > 0))
            if not len(found):
                out.append([])
                continue
            sims = np.round(row[found], 12)
            best = np.lexsort((self.place[found], -sims))[:k]
            found, sims = found[best], sims[best]
            own = [made["own_terms"][i] for i in found.tolist()]
            scratch[terms] = weight
            votes = scratch[np.concatenate(own)] * np.concatenate([made["own_votes"][i] for i in found.tolist()])
            scratch[terms] = 0
            votes = np.add.reduceat(votes, np.cumsum([0, *map(len, own[:-1])]))
            out.append(list(zip(self.place[found].tolist(), sims.tolist(), votes.tolist())))
        return out

    def nearest(self, counts: dict[int, int], k: int) -> list[tuple[int, float]]:
        return [(i, s) for i, s, _ in self.nearest_all([counts], k)[0]]


@dataclass
class Judge:
    """Vocabulary, index and calibration; small enough to travel with the tasks (its bounds are parameters of ``fit``)."""

    vocabulary: dict[str, int]
    index: BlockMaxIndex
    base_rate: float
    k: int
    prior_weight: float = 0.01
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    sent: tuple | None = None

    def raw(self, near: list[tuple[int, float, float]]) -> float:
        """Vote share, weighted by the marked part of each cosine, with the base rate as a further vote; 0 without neighbours."""
        if not near:
            return 0.0
        votes = sum(w * float(self.index.labels[i]) for i, _, w in near)
        return (votes + self.prior_weight * self.base_rate) / (sum(w for _, _, w in near) + self.prior_weight)

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.knots, self.values))


def isotonic(rows: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing rates from (raw score, rows, positives), pooled where they would fall."""
    pools: list[list[float]] = []
    for raw, n, positive in sorted(rows):
        pools.append([raw * n, n, positive])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return (np.array([s / n for s, n, _ in pools]), np.array([(p + 0.02) / (n + 0.2) for _, n, p in pools]))


def draw(labels: DataFrame, positives: int = 1_000, negatives: int = 1_500) -> DataFrame:
    """(key, label, part) of a bounded sample of the narrow rows (key, label): part ``index`` or ``calibration``.

    At most about ``positives`` + ``negatives`` keys, chosen by a hash, go to the index and
    as many others to calibration; of few keys, three quarters and one quarter. A key
    counts once, by its greatest label. Null keys, and labels other than 0 and 1, are left out.
    """
    rows = labels.where(F.col("key").isNotNull() & F.col("label").isin(0, 1)).groupBy("key").agg(F.max("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    u, pick = unit("key", F.lit(5)), F.lit(None).cast("string")
    for y, wanted in ((0, negatives), (1, positives)):
        n = max(1, counts.get(y, 0))
        pick = F.when((F.col("label") == y) & (u < min(0.75, wanted / n)), "index").when(
            (F.col("label") == y) & (u >= 1 - min(0.25, wanted / n)), "calibration").otherwise(pick)
    return rows.withColumn("part", pick).where("part IS NOT NULL")


def fit(labelled: DataFrame, positives: int = 1_000, negatives: int = 1_500, k: int = 25) -> Judge:
    """A judge from rows of (text, label, name), label 0 or 1 and name a bigint that only serves as evidence.

    The sample is drawn by name and text, document frequencies come from all rows.
    Null texts or labels teach nothing. Without rows the judge answers 0.
    """
    rows = stored(labelled.where(F.col("text").isNotNull() & F.col("label").isin(0, 1)).select(
        "text", F.col("label").cast("int").alias("label"), F.col("name").cast("long").alias("name"),
        F.xxhash64("name", "text", "label").alias("key")), "toxicity-labelled")
    picked = draw(rows.select("key", "label"), positives, negatives)
    return fit_sample(rows.join(picked.select("key", "part"), "key"), rows, k)


def fit_sample(sample: DataFrame, corpus: DataFrame, k: int = 25, max_bytes: int = 64_000_000) -> Judge:
    """A judge from a bounded sample of (text, label, name, part), parts as made by ``draw``.

    ``corpus`` has the texts that document frequencies are counted over, in one pass
    without a shuffle of texts. Where the sample's texts exceed ``max_bytes``, a hash of
    the text keeps as many as fit on average. A term weighs log((1 + N) / (1 + n)) + 1 in
    the cosine. In votes a term counts by 1 - exp(-(strength / 8)^2), where strength is
    log(rate ratio) * sqrt(positives that hold it) in the index rows, 0 at least.
    Null texts teach nothing. Without rows the judge answers 0.
    """
    rows = stored(sample.where("text IS NOT NULL").select(
        "text", F.col("label").cast("int").alias("label"), F.col("name").cast("long").alias("name"), "part"), "toxicity-sample")
    volume = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    if volume > max_bytes:
        rows = rows.where(unit("text", F.lit(6)) < max_bytes / volume)
    examples = rows.where("part = 'index'")

    def list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(f for word in set(words_of(text.as_py())) for f in word_features(word))
            if len(seen) > MEMO:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen))], names=["term"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["term"])

    found = examples.select("text").mapInArrow(list_terms, "term string").distinct().toArrow()
    vocabulary = {t: i for i, t in enumerate(sorted(found.column("term").to_pylist()))}
    size = len(vocabulary)
    shipped = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, counts, n = Vectorizer(shipped.value), np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                if text is None:
                    continue
                n += 1
                terms, _ = take.counted(text)
                counts[terms[np.searchsorted(terms, 0):]] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([n])], names=["term", "n"])
        for at in range(0, len(some), 10_000):
            part = some[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["term", "n"])

    terms = corpus.select("text").mapInArrow(count_terms, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size + 1)
    counts[terms.column("term").to_numpy()] = terms.column("n").to_numpy()  # the last place, -1, has the number of texts
    total, held = counts[-1], counts[:-1]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = Vectorizer(shipped.value)
        for batch in batches:
            got = [take(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), batch.column("label"), batch.column("digest"),
                 pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))],
                names=["name", "label", "digest", "terms", "counts"])

    # order by text digest: ids play no part in scores
    found = (examples.select("name", "label", F.md5("text").alias("digest"), "text")
             .mapInArrow(vectors, "name bigint, label int, digest string, terms array<int>, counts array<int>").toArrow())
    names, labels = found.column("name").to_pylist(), found.column("label").to_pylist()
    keys = list(zip(found.column("digest").to_pylist(), labels, [(x is not None, x or 0) for x in names]))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    inside, times = found.column("terms"), found.column("counts")
    n, positive = len(labels), sum(labels)
    p, m = np.zeros(size), np.zeros(size)
    for terms, label in zip(inside, labels):
        (p if label else m)[terms.values.to_numpy()] += 1
    ratio = (p + 0.1) / (positive + 1) / ((m + 0.5) / (n - positive + 1))
    strength = np.maximum(0.0, np.log(ratio)) * np.sqrt(p)
    index = BlockMaxIndex(size, np.log((1 + total) / (1 + held)) + 1, np.array([labels[i] for i in order], np.int8),
                          [names[i] for i in order], math.log(1 + total) + 1, 1 - np.exp(-(strength / 8) ** 2))
    index.fill(dict(zip(inside[i].as_py(), times[i].as_py())) for i in order)
    del found, inside, times
    judge = Judge(vocabulary, index, positive / n if n else 0.0, k)
    told = score(rows.where("part = 'calibration'"), judge).groupBy(F.round("raw", 2).alias("raw")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()
    if told:
        judge.knots, judge.values = isotonic([(r["raw"], r["n"], r["p"]) for r in told])
    return judge


def score(docs: DataFrame, judge: Judge, evidence: int = 3) -> DataFrame:
    """The rows of ``docs`` without text, with raw, score and evidence (nearest examples: name, label, cosine).

    A row's whole text, however long, is all that counts. A null, empty or unknown text has no neighbours; its score
    is the calibrated rate of such rows. Columns of the added names are replaced; repeated rows are judged alike.
    """
    rows = docs.drop("raw", "score", "evidence")
    kept = [f for f in rows.schema.fields if f.name != "text"]
    item = T.StructType([T.StructField("name", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    schema = T.StructType([*kept, T.StructField("raw", T.DoubleType()), T.StructField("score", T.DoubleType()),
                           T.StructField("evidence", T.ArrayType(item))])
    kind = pa.list_(pa.struct([("name", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    sc = docs.sparkSession.sparkContext
    if judge.sent is None or judge.sent[0] is not sc:
        judge.sent = sc, sc.broadcast((judge.vocabulary, judge.index))
    shipped, light = judge.sent[1], replace(judge, vocabulary={}, index=None, sent=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = shipped.value
        judge = replace(light, vocabulary=vocabulary, index=index)
        take = Vectorizer(judge.vocabulary)
        for batch in batches:
            raw, shown = [], []
            found = (near for at in range(0, batch.num_rows, BATCH) for near in judge.index.nearest_all(
                [take.counted(text.as_py()) for text in batch.column("text").slice(at, BATCH)], judge.k))
            for near in found:
                raw.append(judge.raw(near))
                shown.append([{"name": judge.index.names[i], "label": int(judge.index.labels[i]), "cosine": s} for i, s, _ in near[:evidence]])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(raw, pa.float64()),
                 pa.array([judge.calibrated(r) for r in raw], pa.float64()), pa.array(shown, kind)],
                names=[*[f.name for f in kept], "raw", "score", "evidence"])

    return rows.mapInArrow(run, schema)
