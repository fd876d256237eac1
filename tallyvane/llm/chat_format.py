"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once; the template's markers are special tokens of the
tokenizer, so no token straddles a marker and a text. The rendered string is
encoded once with character offsets. Turn spans and token spans are both sorted,
so each turn finds its tokens by two binary searches, and the tokens of assistant
texts form the loss mask.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a template or tokenizer could take for control; inside roles and texts they are escaped.
CONTROLS = (OPEN, MIDDLE, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"

RENDERED = "conv_id bigint, n_turns bigint, formatted string"


@dataclass(frozen=True)
class Template:
    """``OPEN role MIDDLE text CLOSE`` per turn.

    In roles and texts every escape character is doubled, and one is put after the
    first character of each control string, which breaks the string. Neither step
    can produce what the other one does, so ``unescape`` undoes both.
    """

    learned_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = CONTROLS
    _broken: str = field(init=False, default="")

    def __post_init__(self):
        if any(len(c) < 2 or ESCAPE in c for c in self.controls) or not {OPEN, MIDDLE, CLOSE} <= set(self.controls):
            raise ValueError("controls need two characters each, no escape character, and the three markers")
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        object.__setattr__(self, "_broken", f"{ESCAPE}|{heads}")

    def escape_column(self, text: Column) -> Column:
        return F.regexp_replace(text, self._broken, f"$0{ESCAPE}")

    def escape(self, text: str) -> str:
        return re.sub(self._broken, lambda m: m[0] + ESCAPE, text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)

    def render_column(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(OPEN), self.escape_column(role), F.lit(MIDDLE), self.escape_column(text), F.lit(CLOSE))

    def parse(self, formatted: str) -> list[tuple[str, int, int]]:
        """(role, first, last) of each turn; ``formatted[first:last]`` is its escaped text."""
        turns, at = [], 0
        while at < len(formatted):
            middle = formatted.index(MIDDLE, at)
            last = formatted.index(CLOSE, middle)
            turns.append((self.unescape(formatted[at + len(OPEN):middle]), middle + len(MIDDLE), last))
            at = last + len(CLOSE)
        return turns


def render(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored. Turns
    are ordered by (turn, role, text), nulls first, so ties have one result and equal
    rows stay as equal turns. A null role or text is an empty one; rows with a null
    conv_id form one conversation. An empty table gives no rows. A conversation is
    one string and must fit a row; nothing else is gathered.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    # rendered after the sort: escaped text could order ties differently
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: template.render_column(t["role"], t["text"])), "").alias("formatted"))


@lru_cache(maxsize=2)
def _tokenizer(path: str, markers: tuple[str, ...]):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in markers])
    return tokenizer


def loss_tokens(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Mask of tokens that lie in the spans; both are sorted (first, last) pairs.

    Byte-level tokens may share a character, so token ends are sorted but not unique.
    """
    mask = np.zeros(len(offsets), bool)
    if len(offsets):
        lo = np.searchsorted(offsets[:, 0], spans[:, 0], "left")
        hi = np.searchsorted(offsets[:, 1], spans[:, 1], "right")
        for a, b, (first, last) in zip(lo, hi, spans):
            if last > first:
                mask[a:b] = True
    return mask


def masked_characters(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Merged (first, last) character spans under the mask."""
    spans: list[tuple[int, int]] = []
    for first, last in offsets[mask].tolist():
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
        else:
            spans.append((first, last))
    return spans


def encode(rendered: DataFrame, tokenizer_path: str, template: Template = Template()) -> DataFrame:
    """Add token_ids, loss_mask (0/1 per token) and loss_spans (character spans) to rendered rows.

    Works on (conv_id, n_turns, formatted); one conversation at a time is encoded, so
    memory follows the longest one and not the batch.
    """
    schema = T._parse_datatype_string(
        RENDERED + ", token_ids array<int>, loss_mask array<tinyint>, loss_spans array<struct<first:int,last:int>>")
    arrow = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8())),
        ("loss_spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
    learned = frozenset(template.learned_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path, (OPEN, MIDDLE, CLOSE))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, masks, spans = [], [], []
                for text in part.column("formatted"):
                    text = text.as_py()
                    got = tokenizer.encode(text, add_special_tokens=False)
                    offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
                    wanted = [(a, b) for role, a, b in template.parse(text) if role in learned]
                    mask = loss_tokens(offsets, np.array(wanted, np.int64).reshape(-1, 2))
                    ids.append(np.array(got.ids, np.int32))
                    masks.append(mask.astype(np.int8))
                    spans.append([{"first": a, "last": b} for a, b in masked_characters(offsets, mask)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("n_turns"), part.column("formatted").cast(pa.string()),
                     pa.array(ids, arrow.field("token_ids").type), pa.array(masks, arrow.field("loss_mask").type),
                     pa.array(spans, arrow.field("loss_spans").type)], schema=arrow)

    return rendered.select("conv_id", "n_turns", "formatted").mapInArrow(run, schema)


def format_chats(conversations: DataFrame, tokenizer_path: str, template: Template = Template()) -> DataFrame:
    """Rendered conversations with token ids, loss mask and loss spans; see ``render`` and ``encode``."""
    return encode(render(conversations, template), tokenizer_path, template)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What a reader of the output sees: turns parsed and unescaped, and the text under the loss mask."""
    from hashlib import sha256

    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch.column("conv_id"), batch.column("formatted"), batch.column("loss_spans")):
                text = text.as_py()
                turns = [(role, template.unescape(text[a:b])) for role, a, b in template.parse(text)]
                # two assistant turns in a row are two spans: markers between them are never masked
                loss = "".join(template.unescape(text[s["first"]:s["last"]]) for s in spans.as_py())
                whole = sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                rows.append((conv.as_py(), len(turns), whole.hexdigest(), len(loss), sha256(loss.encode()).hexdigest(),
                             len(text)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(),
                                                          pa.int64()))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
