"""Quality rules per document and a verdict per host.

Base counts are made per text in Arrow batches. Failures are then counted by host,
each host's rate is shrunk by a beta prior fitted to all hosts (method of moments),
and hosts whose shrunk rate is too high take their documents with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.operators.materialize import stored
from tallyvane.llm.buffers import SPACE, Piece, joined, pieces, word_hashes, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1
#: 1 for the first byte of each code point outside white space
POINT = np.array([(b & 0xC0) != 0x80 and not SPACE[b] for b in range(256)], np.int64)


def per_text(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[start[1:]] - total[start[:-1]]


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in some 3-word window found at least twice in that text."""
    n = len(hashes)
    cover = np.zeros(n + 1, np.int64)
    if n >= 3:
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        window = joined(hashes, 3)[inside]
        order = np.lexsort((window, owner[inside]))
        w, o = window[order], owner[inside][order]
        same = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(w), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        cover[at] = cover[at + 1] = cover[at + 2] = 1
    return per_text(cover[:n], first)


def repeated_lines(piece: Piece) -> np.ndarray:
    out = np.zeros(piece.last - piece.first, np.int64)
    whole = piece.data.tobytes()
    for i, (a, b) in enumerate(zip(piece.start[:-1].tolist(), piece.start[1:].tolist())):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def base_counts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A word is a run of characters other than blank and \\t to \\r; a null text has
    none. Columns of those names are replaced.
    """
    rows = docs.drop(*COUNTS)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for piece in pieces(batch.column("text")):
                begin, end, first = words(piece)
                hashes = word_hashes(piece, begin, end)
                parts.append((np.diff(first), per_text(POINT[piece.data], piece.start), per_text(SYMBOL[piece.data], piece.start),
                              repeated_lines(piece), repeated_words(hashes, first)))
            columns = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *[pa.array(c, pa.int64()) for c in columns]],
                                             names=[*[f.name for f in kept], *COUNTS])

    return rows.mapInArrow(run, schema)


def host_verdicts(judged: DataFrame, max_rate: float = 0.5, weak_prior: float = 20.0) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_ok from rows of (host, base_failed).

    The prior's mean and strength come from the mean and variance of the host rates;
    where they don't determine it (one host, equal rates), the strength is
    ``weak_prior``. A null host is no host.
    """
    hosts = (judged.where(F.col("host").isNotNull()).groupBy("host")
             .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    mean, spread = prior["m"] or 0.0, prior["v"] or 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 1e-12 else 0.0
    if strength <= 0:
        strength = weak_prior
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return (hosts.withColumn("shrunk_rate", shrunk)
            .select("host", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") <= max_rate).alias("host_ok")))


def apply_host_rules(docs: DataFrame, host: str, min_words: int = 50, max_repeat_percent: int = 50,
                     max_rate: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (text and the column named by ``host``) with counts, base_failed, shrunk_rate and kept.

    A row is kept if its own rules pass and its host's shrunk failure rate is at most
    ``max_rate``; rows without a host are judged alone. Repeated rows count each.
    Columns host, base_failed, n_docs, n_failed, shrunk_rate, host_ok and kept of the
    input are replaced.
    """
    names = ("base_failed", "n_docs", "n_failed", "shrunk_rate", "host_ok", "kept")
    rows = base_counts(docs.withColumn("host", F.col(host).cast("string")).drop(*names))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", failed), "host-rules")  # texts are read once; these rows are narrow
    verdicts = host_verdicts(rows.select("host", "base_failed"), max_rate)
    return (rows.join(verdicts, "host", "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))))
