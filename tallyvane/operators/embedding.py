"""Embedding of texts in Arrow batches with per-item fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[list[float]]]


def hashing_encoder(dim: int) -> Encoder:
    """Deterministic offline encoder: signed word hashing, length 1.

    A text without words, or whose words cancel out, takes the one direction that its own digest names.
    """
    import zlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            if not out[i].any():
                out[i, zlib.crc32(text.lower().encode()) % dim] = 1.0
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()

    return encode


def embed(items: DataFrame, text: str, encoder: Encoder, chunk: int = 100) -> DataFrame:
    """Adds ``embedding``; a failing chunk is retried item by item, bad items get NULL.

    Only one chunk's texts and vectors are Python objects at a time; the rest of a batch stays in its Arrow buffers.
    """
    schema = items.schema.simpleString()[7:-1] + ",embedding:array<double>"

    def encode_chunk(texts: list[str]) -> list[list[float] | None]:
        try:
            vectors = encoder(texts)
            if len(vectors) == len(texts):
                return list(vectors)
        except Exception:  # noqa: BLE001 - isolate the bad item below
            pass
        out: list[list[float] | None] = []
        for t in texts:
            try:
                (v,) = encoder([t])
                out.append(list(v))
            except Exception:  # noqa: BLE001
                out.append(None)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                texts = ["" if t is None else t for t in part.column(text).to_pylist()]
                vectors = pa.array(encode_chunk(texts), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, "embedding"])

    return items.mapInArrow(run, schema)


def news_text() -> Column:
    """Content, else summary, else title."""
    clean = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return F.coalesce(clean("content"), clean("summary"), clean("title"))


def event_text() -> Column:
    return F.trim(F.concat_ws(": ", "event_type", F.coalesce("description", F.lit(""))))


def analysis_text(record: str = "llm_analysis") -> Column:
    """Summary of the stored record, else the record itself as JSON."""
    summary = F.try_variant_get(record, "$.summary", "string")
    return F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.to_json(record))
