"""Language identification with hyperdimensional letter profiles.

Each letter has a random vector of +1 and -1, fixed by its code point. A trigram's
vector binds its letters: the product of the first one rotated twice, the second
one rotated once and the third one. A text's vector bundles (sums) its trigrams, a
language prototype bundles its training texts, and texts are compared with
prototypes by cosine. Bundling is linear, so a text's distinct trigrams are counted
first and each bound vector is built once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.common import unit

UNDETERMINED = "und"
CACHED_TRIGRAMS = 60_000  # bounds a worker's memory for any script


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters (surrogates are none)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three 21-bit code points each) of the lower-cased text and their counts.

    Every run of other characters is one blank; the text begins and ends with one.
    Both arrays are empty for a text without letters.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.where(letter, points, 32).astype(np.uint64)
    points = points[np.append(True, letter[1:] | letter[:-1])]
    return np.unique(points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:], return_counts=True)


@dataclass
class Encoder:
    """Bound trigram vectors of ``dims`` signs."""

    dims: int = 1024
    seed: int = 17
    _letter: dict[int, np.ndarray] = field(default_factory=dict)
    _row: dict[int, int] = field(default_factory=dict)
    _table: np.ndarray | None = None

    def letter(self, point: int) -> np.ndarray:
        if point not in self._letter:
            if len(self._letter) > CACHED_TRIGRAMS:
                self._letter.clear()
            bits = np.random.default_rng([self.seed, point]).integers(0, 2, self.dims, dtype=np.int8)
            self._letter[point] = bits * np.int8(2) - np.int8(1)
        return self._letter[point]

    def bound(self, trigram: int) -> np.ndarray:
        a, b, c = trigram >> 42, trigram >> 21 & 0x1FFFFF, trigram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors; exact, since sums stay far below 2**53."""
        total = np.zeros(self.dims)
        for at in range(0, len(grams), 4096):
            part = grams[at:at + 4096].tolist()
            rows = np.fromiter((self._row.get(g, -1) for g in part), np.int64, len(part))
            if (rows < 0).any():
                self._add(part)
                rows = np.fromiter((self._row[g] for g in part), np.int64, len(part))
            weight = counts[at:at + 4096].astype(np.float32)
            if weight.sum() < 1 << 24:
                total += weight @ self._table[rows].astype(np.float32)
            else:
                total += counts[at:at + 4096].astype(np.float64) @ self._table[rows].astype(np.float64)
        return total

    def _add(self, grams: list[int]) -> None:
        if self._table is None or len(self._row) + len(grams) > CACHED_TRIGRAMS:
            self._row, self._table = {}, np.zeros((8192, self.dims), np.int8)
        need = len(self._row) + len(grams)
        if need > len(self._table):
            self._table = np.concatenate([self._table, np.zeros((need, self.dims), np.int8)])
        for g in grams:
            if g not in self._row:
                self._row[g] = len(self._row)
                self._table[self._row[g]] = self.bound(g)


@dataclass(frozen=True)
class Profiles:
    """Unit prototypes, one row per language in order of name."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    dims: int
    seed: int

    @property
    def chance(self) -> float:
        """Three deviations of the cosine with a prototype that shares no trigram; nothing at or below it tells a language."""
        return 3 / float(np.sqrt(self.dims))

    def judge(self, encoder: Encoder, text: str | None) -> tuple[str, float]:
        """(language, cosine clipped to 0..1); equal cosines go to the first name."""
        grams, counts = trigrams(text) if text else (np.zeros(0, np.uint64), None)
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0
        vector = encoder.bundle(grams, counts)
        size = float(np.sqrt(vector @ vector))
        cosines = self.vectors @ vector / size if size else np.zeros(len(self.languages))
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))


def fit_profiles(labelled: DataFrame, dims: int = 1024, seed: int = 17, rows_per_language: int = 20_000,
                 max_languages: int = 2_000) -> Profiles:
    """Prototypes from (text, lang); rows with a null lang or text teach nothing.

    At most about ``rows_per_language`` rows of a language are used, those with the
    smallest hash of (sample_key, text); ``sample_key`` is an optional column that
    tells copies of a text apart. Bundles are summed by Spark per (language,
    dimension), so the driver gets languages x dims numbers; more than
    ``max_languages`` languages are refused.
    """
    key = F.col("sample_key") if "sample_key" in labelled.columns else F.lit(0)
    rows = labelled.select("text", "lang", key.alias("k")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).take(max_languages + 1)}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Profiles((), np.zeros((0, dims)), dims, seed)
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, rows_per_language / n))])
    sample = rows.where(unit("k", "text") < share[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dims, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                grams, n = trigrams(text.as_py())
                if len(grams):
                    lang = lang.as_py()
                    sums[lang] = sums.get(lang, 0) + encoder.bundle(grams, n)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)),
                 pa.array(np.rint(total).astype(np.int64))], names=["lang", "dim", "value"])

    summed = sample.mapInArrow(run, "lang string, dim int, value bigint").groupBy("lang", "dim").agg(F.sum("value").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():
        found.setdefault(r["lang"], np.zeros(dims))[r["dim"]] = r["v"]
    languages = tuple(sorted(found))
    vectors = np.array([found[k] / max(1e-12, np.linalg.norm(found[k])) for k in languages]).reshape(-1, dims)
    return Profiles(languages, vectors, dims, seed)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score added; columns of those names are replaced.

    A null text and a text without letters are ``und`` with score 0. Each row is
    judged on its whole text alone; row order, copies and other columns play no part.
    """
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(profiles.dims, profiles.seed)
        for batch in batches:
            got = [profiles.judge(encoder, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, profiles: Profiles, accepted: tuple[str, ...] | None = None,
                    min_score: float = 0.0) -> DataFrame:
    """Rows of ``docs`` in an accepted language (any learned one by default), unchanged.

    ``und`` and scores under ``min_score`` go; copies are judged alike and all stay. Only the text
    goes to Python and only the decision comes back.
    """
    @F.arrow_udf("boolean")
    def fits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(profiles.dims, profiles.seed)
        for column in texts:
            got = (profiles.judge(encoder, t.as_py()) for t in column)
            yield pa.array([lang != UNDETERMINED and score >= min_score and (accepted is None or lang in accepted)
                            for lang, score in got], pa.bool_())

    return docs.where(fits("text"))
