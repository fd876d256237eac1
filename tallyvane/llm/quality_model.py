"""Text quality learned from trusted positives and unlabelled text only.

A text becomes binned figures of its form (kinds of characters, punctuation, word
lengths, repeated words, word triples and lines) and hashed words. A linear model over
them minimises the non-negative unbiased risk

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

with logistic loss, by whole-sample gradient steps whose sums are Spark jobs. When the second part
falls below zero the step goes against it instead, as the model then fits the positives too closely.
The class prior is estimated first: a positive-or-unlabelled model is trained on half of the sample, and
the prior is the least ratio of unlabelled to positive mass above any score on the other half, with a margin for chance.
A quarter of the sample is kept from training; there prior * positive mass / unlabelled mass, made monotone in the
margin, is the probability that a margin stands for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm import buffers
from tallyvane.operators.materialize import stored

BINS = 16
HASHED = 1 << 12
PUNCTUATION = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
#: Kinds of bytes: other controls, A-Z, a-z, 0-9, blanks, line breaks, outside ASCII, then each punctuation mark.
KIND = np.zeros(256, np.int64)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[10], KIND[128:] = 1, 2, 3, 5, 6
KIND[[32, 9, 11, 12, 13]] = 4
KIND[PUNCTUATION] = 7 + np.arange(len(PUNCTUATION))
KINDS = 7 + len(PUNCTUATION)
LINE_BREAK = np.zeros(256, bool)
LINE_BREAK[10] = True
FIGURES = KINDS + 8
SIZE = 1 + FIGURES * BINS + HASHED


def distinct_in(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs: their owners, values, counts, and the number per owner."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]) if len(owner) else np.zeros(0, np.int64)
    return owner[at], value[at], np.diff(np.r_[at, len(owner)]), np.bincount(owner[at], minlength=n)


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(piece: buffers.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all texts of a piece, by text."""
    n = piece.last - piece.first
    text = np.repeat(np.arange(n), np.diff(piece.start))
    kinds = np.bincount(text * KINDS + KIND[piece.data], minlength=n * KINDS).reshape(n, KINDS)
    begin, end, first = buffers.words(piece, buffers.LOWER)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    hashes = buffers.word_hashes(piece, begin, end, buffers.LOWER)
    who, word, times, distinct = distinct_in(owner, hashes, n)
    triple = buffers.joined(hashes, 3)
    inside = owner[2:] == owner[:-2] if len(triple) else np.zeros(0, bool)
    triples = distinct_in(owner[:len(triple)][inside], triple[inside], n)[3]
    line_begin, line_end, line_first = buffers.words(piece, buffers.SAME, LINE_BREAK)
    lines = np.diff(line_first)
    line = distinct_in(np.repeat(np.arange(n), lines), buffers.word_hashes(piece, line_begin, line_end), n)[3]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, who, times)
    size = np.diff(piece.start)
    letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 6]
    rates = np.column_stack([
        kinds[:, 0] / np.maximum(size, 1), share(kinds[:, 1], letters), share(kinds[:, 2], letters), share(kinds[:, 3], size),
        share(kinds[:, 4], size), share(kinds[:, 5], size), share(kinds[:, 6], size), share(kinds[:, 7:].T, words).T,
        share(letters, size), share(size, words) / 64, share(words - distinct, words), share(np.maximum(words - 2, 0) - triples, words),
        share(lines - line, lines), share(most, words), share(words, lines) / 64])
    level = np.minimum(2 * np.log2(1 + 63 * np.minimum(rates, 4)), BINS - 1).astype(np.int64)
    level = np.column_stack([level, np.minimum(np.log2(1 + words), BINS - 1).astype(np.int64)])
    binned = 1 + np.arange(FIGURES) * BINS + level
    weight = 1 + np.log(times)
    norm = np.sqrt(np.bincount(who, weight * weight, minlength=n))
    owners = np.concatenate([np.arange(n), np.repeat(np.arange(n), FIGURES), who])
    order = np.argsort(owners, kind="stable")
    index = np.concatenate([np.zeros(n, np.int64), binned.ravel(), 1 + FIGURES * BINS + (word % np.uint64(HASHED)).astype(np.int64)])
    value = np.concatenate([np.ones(n), np.full(n * FIGURES, 1 / math.sqrt(FIGURES)), weight / norm[who] if len(who) else weight])
    return owners[order], index[order], value[order]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def score(self, margin: np.ndarray) -> np.ndarray:
        """Calibrated probability; a hundredth of it stays with the margin itself, so that equal pools keep their order."""
        raw = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return raw if self.knots is None or not len(self.knots) else 0.99 * np.interp(margin, self.knots, self.values) + 0.01 * raw


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sample(docs: DataFrame, trusted: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(text, kind): distinct texts, kind 1 trusted and 0 unlabelled, at most so many of each, drawn by text digest.

    Only ids and digests are joined and drawn from; the texts of the drawn rows are then fetched by a bounded broadcast.
    A text under several rows counts once.
    """
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("digest"))
    narrow = rows.select("doc_id", "digest")
    total = max(1, narrow.count())

    def draw(found: DataFrame, want: int, salt: int, most: int) -> DataFrame:
        # a first cut by digest, three times as wide as needed, so that only a bounded part is grouped and ordered
        lot = F.xxhash64("digest", F.lit(salt))
        width = min(1.0, 3.0 * want / max(1, most))
        near = found.where(F.pmod(lot, F.lit(1 << 32)) < int(width * (1 << 32)))
        one = near.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        return one.withColumn("lot", lot).orderBy("lot", "digest").limit(want).drop("lot")

    good = stored(narrow.join(trusted.select("doc_id").distinct(), "doc_id"), "quality-trusted")
    chosen = stored(draw(good, positives, 1, good.count()).withColumn("kind", F.lit(1)).unionByName(
        draw(narrow, unlabelled, 2, total).withColumn("kind", F.lit(0))), "quality-chosen")
    return rows.join(F.broadcast(chosen), ["doc_id", "digest"]).dropDuplicates(["digest", "kind"]).select("text", "kind", "digest")


def _vectors(rows: DataFrame) -> DataFrame:
    """The sampled texts as blocks of vectors: bytes of kind, part, start (int32), terms (int16) and value (float32).

    ``part`` 0 to 3 splits texts by digest. A block holds about 2 MB of text, so a pass reads few rows and no lists.
    """
    names = ["kind", "part", "start", "terms", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, part = (batch.column(c).to_numpy().astype(np.int8) for c in ("kind", "part"))
            for piece in buffers.pieces(batch.column("text")):
                owner, index, value = features(piece)
                start = np.searchsorted(owner, np.arange(piece.last - piece.first + 1)).astype(np.int32)
                block = (kind[piece.first:piece.last], part[piece.first:piece.last], start, index.astype(np.int16), value.astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], names=names)

    part = F.pmod(F.xxhash64("digest", F.lit(3)), F.lit(4)).cast("int")
    return rows.select("text", "kind", part.alias("part")).mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def _blocks(batches: Iterator[pa.RecordBatch], parts: tuple[int, ...], weights: np.ndarray):
    """Per block: kind, owner, terms, value and margin of its texts of the given parts."""
    for batch in batches:
        for row in range(batch.num_rows):
            kind, part, start, terms, value = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (
                ("kind", np.int8), ("part", np.int8), ("start", np.int32), ("terms", np.int16), ("value", np.float32)))
            owner = np.repeat(np.arange(len(kind)), np.diff(start))
            wanted = np.isin(part, parts)
            here = wanted[owner]
            owner, terms, value = (np.cumsum(wanted) - 1)[owner[here]], terms[here], value[here]
            kind = kind[wanted]
            yield kind, owner, terms, value, np.bincount(owner, weights[terms] * value, minlength=len(kind))


def _sums(vectors: DataFrame, weights: np.ndarray, parts: tuple[int, ...]) -> dict:
    """Sums over positives and unlabelled: rows, losses l(f) and l(-f), and their gradients; one small row per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, loss, gradient = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 2, SIZE))
        for kind, owner, terms, value, f in _blocks(batches, parts, weights):
            rows += np.bincount(kind, minlength=2)
            for sign, way in ((0, 1.0), (1, -1.0)):
                loss[:, sign] += np.bincount(kind, _softplus(-way * f), minlength=2)
                slope = -way / (1 + np.exp(np.clip(way * f, -30, 30)))
                for k in (0, 1):
                    gradient[k, sign] += np.bincount(terms, np.where(kind == k, slope, 0.0)[owner] * value, minlength=SIZE)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([rows, loss.ravel(), gradient.ravel()])], pa.list_(pa.float64()))], names=["sums"])

    found = vectors.mapInArrow(run, "sums array<double>").toArrow().column("sums").combine_chunks()
    total = found.flatten().to_numpy().reshape(-1, 6 + 4 * SIZE).sum(axis=0) if len(found) else np.zeros(6 + 4 * SIZE)
    rows = np.maximum(total[:2], 1)
    return {"rows": total[:2], "loss": total[2:6].reshape(2, 2) / rows[:, None], "gradient": total[6:].reshape(2, 2, SIZE) / rows[:, None, None]}


def _descend(vectors: DataFrame, parts: tuple[int, ...], rounds: int, rate: float, penalty: float, gradient_of) -> np.ndarray:
    """Adam over whole-sample gradients, each a Spark job over the stored sample."""
    weights, first, second = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    for t in range(1, rounds + 1):
        g = gradient_of(_sums(vectors, weights, parts)) + penalty * np.r_[0.0, weights[1:]]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = rate * (1 - (t - 1) / (2 * rounds))
        weights = weights - step * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-9)
    return weights


def _by_margin(vectors: DataFrame, parts: tuple[int, ...], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins to a twentieth, falling, and how many positives and unlabelled texts have each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, _, _, _, f in _blocks(batches, parts, weights):
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.round(f * 20) / 20)], names=["kind", "f"])

    held = vectors.mapInArrow(run, "kind int, f double").groupBy("f").agg(
        F.count_if(F.col("kind") == 1).alias("p"), F.count_if(F.col("kind") == 0).alias("u")).orderBy(F.desc("f")).toArrow()
    return tuple(held.column(c).to_numpy() for c in ("f", "p", "u"))


def estimate_prior(vectors: DataFrame, rounds: int = 15) -> float:
    """The largest share of positives among the unlabelled that fits every score threshold.

    P(f >= t) of the unlabelled is at least prior times that of the positives. Both shares come from the half that the
    model did not see; one standard deviation is added, and thresholds above a tenth of the positives count.
    """
    weights = _descend(vectors, (0, 1), rounds, 0.3, 1e-3, lambda s: s["gradient"][1, 0] / 2 + s["gradient"][0, 1] / 2)
    _, p, u = _by_margin(vectors, (2, 3), weights)
    p, u = np.cumsum(p), np.cumsum(u)
    if not len(p) or not p[-1] or not u[-1]:
        return 0.5
    above_p, above_u = p / p[-1], u / u[-1]
    spread = np.sqrt(above_p * (1 - above_p) / p[-1] + above_u * (1 - above_u) / u[-1])
    ratio = (above_u + spread)[above_p >= 0.1] / above_p[above_p >= 0.1]
    return float(np.clip(ratio.min(), 0.02, 0.98))


def calibrate(margins: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising probabilities prior * positive mass / unlabelled mass, pooled where they would fall; knots are margins."""
    if not p.sum() or not u.sum():
        return np.zeros(0), np.zeros(0)
    pools: list[list[float]] = []
    for f, a, b in sorted(zip(margins, p / p.sum() * prior, u / u.sum())):
        pools.append([f * (a + b), a + b, a, b])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            top = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], top)]
    return (np.array([f / w for f, w, _, _ in pools]), np.array([min(1.0, a / b) if b else 1.0 for _, _, a, b in pools]))


def fit(docs: DataFrame, trusted: DataFrame, positives: int = 20_000, unlabelled: int = 40_000, rounds: int = 150,
        penalty: float = 2e-5, prior: float | None = None) -> Model:
    """A model from ``docs`` (doc_id, text), unlabelled, and the ids of ``trusted`` (doc_id) among them.

    At most ``positives`` and ``unlabelled`` distinct texts are learned from, drawn by text digest; null texts and ids teach
    nothing. Without a trusted text the model says 0.5 to everything. ``prior`` skips its estimate.
    """
    drawn = sample(docs, trusted, positives, unlabelled)
    vectors = stored(_vectors(drawn.repartition(12)), "quality-vectors")
    if not _sums(vectors, np.zeros(SIZE), (0, 1, 2))["rows"][1]:
        return Model(np.zeros(SIZE), 0.5)
    prior = estimate_prior(vectors) if prior is None else prior

    def gradient(s: dict) -> np.ndarray:
        negative = s["loss"][0, 1] - prior * s["loss"][1, 1]
        against = s["gradient"][0, 1] - prior * s["gradient"][1, 1]
        return prior * s["gradient"][1, 0] + against if negative >= 0 else -against

    weights = _descend(vectors, (0, 1, 2), rounds, 0.3, penalty, gradient)
    return Model(weights, prior, *calibrate(*_by_margin(vectors, (3,), weights), prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` without text, with ``score``, the probability of good quality.

    The whole text is all that counts: equal texts score alike. A null text is an empty one, which has a score like any other.
    A column named score is replaced, others pass, repeated rows stay; very long texts are worked on one by one.
    """
    rows = docs.drop("score")
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for piece in buffers.pieces(batch.column("text")):
                n = piece.last - piece.first
                owner, index, value = features(piece)
                margin = np.bincount(owner, model.weights[index] * value, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f.name).slice(piece.first, n) for f in kept], pa.array(model.score(margin))],
                    names=[*[f.name for f in kept], "score"])

    return rows.select(*[f.name for f in kept], "text").mapInArrow(run, schema)
