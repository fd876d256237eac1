"""Cheapest repair of damaged conversations, by a dynamic programme with checkpoints.

A conversation is right if its roles read system (or not), then user and assistant in
turn. Rows are kept, given another role, deleted, or new empty turns are inserted; of
all cheapest ways the one whose letters (D, I, K, R) come first is taken.

Rows are put in order once, by range, and cut into blocks of at most ``BLOCK`` rows, so
a conversation of any length is spread over tasks. A block is a 4 x 4 matrix of costs
between the states at its ends; chaining the matrices backwards gives the cost vector at
every block's end, which is all that a block needs to walk forward on its own. Inside a block
vectors are kept at every square root of its rows only and recomputed between them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.materialize import stored

BLOCK_BITS = 12
BLANKS = " \t\n\x0b\x0c\r"
FAR = 1 << 60
#: States: nothing yet, behind system, behind user, behind assistant; and the state behind an inserted turn.
NEXT = (2, 2, 3, 2)
#: Costs to go behind the last row.
END = (0, 6, 3, 0)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3


def back(code: int, later: tuple | list) -> tuple[int, int, int, int]:
    """Cost to go in each state before a row, from those behind it; a row's code is 4 * fault + role."""
    fault, role = divmod(code, 4)
    d0, d1, d2, d3 = (DELETE + x for x in later)
    if fault < 2:
        extra = TRUNCATED * fault
        user = later[2] + extra + (KEEP if role == 1 else REROLE)
        assistant = later[3] + extra + (KEEP if role == 2 else REROLE)
        if role == 0:
            d0 = min(d0, later[1] + extra + KEEP)
        d0, d1, d2, d3 = min(d0, user), min(d1, user), min(d2, assistant), min(d3, user)
    c2, c3 = min(d2, d3 + INSERT), min(d3, d2 + INSERT)
    return min(d0, c2 + INSERT), min(d1, c2 + INSERT), c2, c3


def matrix(codes: list[int]) -> list[int]:
    """Costs from each state before the rows (outer) to each state behind them (inner)."""
    ends = [tuple(0 if s == end else FAR for s in range(4)) for end in range(4)]
    for code in reversed(codes):
        ends = [back(code, e) for e in ends]
    return [min(ends[end][s], FAR) for s in range(4) for end in range(4)]


def walk(codes: list[int], end: tuple | list, entries: list[int], last: bool) -> dict[int, tuple[list[str], list[str], int]]:
    """Per entry state: letters and made turns of each row, and the state behind the rows.

    Made turns: k, u, a for the row itself (kept, as user, as assistant), U and A for new ones. Turns made behind the
    last row of a conversation are told with it.
    """
    n = len(codes)
    step = math.isqrt(max(n - 1, 0)) + 1
    vector, checkpoint = tuple(end), {n: tuple(end)}
    for i in range(n - 1, -1, -1):
        vector = back(codes[i], vector)
        if i % step == 0:
            checkpoint[i] = vector
    state = {e: e for e in entries}
    letters = {e: [""] * n for e in entries}
    made = {e: [""] * n for e in entries}
    for begin in range(0, n, step):
        stop = min(begin + step, n)
        cost = [checkpoint[stop]]
        for i in range(stop - 1, begin - 1, -1):
            cost.append(back(codes[i], cost[-1]))
        cost.reverse()
        for e in entries:
            s = state[e]
            for i in range(begin, stop):
                said, new = "", ""
                here, later, (fault, role) = cost[i - begin], cost[i - begin + 1], divmod(codes[i], 4)
                extra = TRUNCATED * fault
                while True:
                    goal = NEXT[s]
                    want = 1 if goal == 2 else 2
                    if here[s] == DELETE + later[s]:
                        said += "D"
                        break
                    if here[s] == INSERT + here[goal]:
                        said, new, s = said + "I", new + "UA"[want - 1], goal
                        continue
                    if s == 0 and role == 0 and here[s] == extra + KEEP + later[1]:
                        said, new, s = said + "K", new + "k", 1
                    elif role == want:
                        said, new, s = said + "K", new + "k", goal
                    else:
                        said, new, s = said + "R", new + "ua"[want - 1], goal
                    break
                letters[e][i], made[e][i] = said, new
            state[e] = s
    if last and n:
        for e in entries:
            s = state[e]
            while END[s]:
                letters[e][-1] += "I"
                made[e][-1] += "U" if NEXT[s] == 2 else "A"
                s = NEXT[s]
            state[e] = s
    return {e: (letters[e], made[e], state[e]) for e in entries}


def _lists(batches: Iterator[pa.RecordBatch], fn, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [out for row in batch.to_pylist() for out in fn(row)]
        yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass(frozen=True)
class Repair:
    """``rows``: every row with its place and fault; ``verdicts``: one row per conversation; ``edits``: letters and made turns per row."""

    rows: DataFrame
    verdicts: DataFrame
    edits: DataFrame

    def turns(self) -> DataFrame:
        """(key, place, step, role, text) of the repaired conversations, in that order."""
        plan = self.edits.where("made <> ''").select("place", F.posexplode(F.filter(F.split("made", ""), lambda c: c != "")).alias("step", "how"))
        how, new = F.col("how"), F.col("how").isin("U", "A")
        return self.rows.select("key", "place", "role", "text").join(plan, "place").select(
            "key", "place", "step",
            F.when(F.lower(how) == "u", "user").when(F.lower(how) == "a", "assistant").otherwise(F.col("role")).alias("role"),
            F.when(new, "").otherwise(F.col("text")).alias("text"))

    def audits(self) -> DataFrame:
        """(key, audit): all letters of a conversation in order."""
        blocks = self.edits.groupBy("key", F.shiftright("place", BLOCK_BITS).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("place", "letters"))).alias("rows"))
        blocks = blocks.select("key", "block", F.array_join(F.transform("rows", lambda r: r["letters"]), "").alias("letters"))
        whole = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "letters"))).alias("blocks"))
        return whole.select("key", F.array_join(F.transform("blocks", lambda b: b["letters"]), "").alias("audit"))


def conversation_key(conv_id: Column) -> Column:
    """A key that keeps rows without an id together."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def in_order(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with key and ``place``, a number that rises by turn (nulls first), role and text digest.

    Null roles and texts are one space. Rows alike in all of it are interchangeable. The order is stored, so every later job sees the same places.
    """
    rows = turns.select(conversation_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    order = ["key", F.asc_nulls_first("turn"), "role", "digest"]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
                  "turns-in-order")


def with_faults(rows: DataFrame) -> DataFrame:
    """Add fault: blank, duplicate (role and text come earlier in the conversation), truncated, or null."""
    text = F.rtrim("text", F.lit(BLANKS))
    repeated = rows.groupBy("key", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(repeated.drop("n"), ["key", "role", "digest"], "left")
    fault = F.when(text == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(
        ~F.right(text, F.lit(1)).isin(".", "!", "?"), "truncated")
    return met.select("key", "turn", "place", "role", fault.alias("fault"))


def repair(turns: DataFrame) -> Repair:
    """Repair the conversations of ``turns`` (conv_id, turn, role, text).

    Costs: a kept row 0, another role 3, a deleted row 4, a new empty turn 3, and 3 for a truncated row that stays; blank
    and duplicate rows must go. Roles count by their first letter; a row whose letter is not s, u or a can't be kept as it is.
    Null ids form one conversation; null roles and texts are one space, null turns come first. Texts of any length count whole,
    repeated rows are duplicates, an empty table gives empty results, other columns are ignored.
    """
    rows = in_order(turns)
    judged = stored(with_faults(rows), "turns-judged")
    fault = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    coded = judged.select("key", "place", (fault * 4 + _role_class(F.col("role"))).alias("code"))
    blocks = coded.groupBy("key", F.shiftright("place", BLOCK_BITS).alias("block")).agg(
        F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "code"))).alias("rows"))
    blocks = stored(blocks.select("key", "block", "first", F.transform("rows", lambda r: r["code"]).alias("codes")), "turn-blocks")
    ends = stored(_ends(blocks), "turn-block-ends")
    walked = stored(_walked(blocks.join(ends.drop("illegal", "cost"), ["key", "block"])), "turn-walks")
    chosen = walked.join(_entries(walked), ["key", "block", "entry"], "left_semi")
    edits = chosen.select("key", "first", F.posexplode(F.arrays_zip("letters", "made")).alias("at", "edit")).select(
        "key", (F.col("first") + F.col("at")).alias("place"), "edit.letters", "edit.made")
    n = lambda f: F.count_if(F.col("fault") == f).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = judged.groupBy("key").agg(gaps, n("blank"), n("duplicate"), n("truncated"))
    costs = ends.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    return Repair(rows, counts.join(costs, "key"), stored(edits, "turn-edits"))


def _role_class(role: Column) -> Column:
    """0, 1, 2 for roles that begin with s, u, a, else 3."""
    letter = F.left(role, F.lit(1))
    return F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)


def _ends(blocks: DataFrame) -> DataFrame:
    """(key, block, is_first, is_last, end, illegal, cost): cost to go behind each block, illegal neighbours up to its
    last row, and the conversation's cost at its first block."""
    shape = pa.schema([("key", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("illegal", pa.int64()),
                       ("head", pa.int64()), ("tail", pa.int64())])
    out = pa.schema([("key", pa.string()), ("block", pa.int64()), ("is_first", pa.bool_()), ("is_last", pa.bool_()),
                     ("end", pa.list_(pa.int64())), ("illegal", pa.int64()), ("cost", pa.int64())])
    legal = {(0, 1), (1, 2), (2, 1)}

    def shrink(row):
        roles = [c % 4 for c in row["codes"]]
        yield {"key": row["key"], "block": row["block"], "costs": matrix(row["codes"]), "head": roles[0], "tail": roles[-1],
               "illegal": sum(p not in legal for p in zip(roles, roles[1:]))}

    def chain(row):
        end, told = END, []
        parts = row["parts"]
        for i in range(len(parts) - 1, -1, -1):
            part = parts[i]
            costs = part["costs"]
            start = tuple(min(costs[4 * s + x] + end[x] for x in range(4)) for s in range(4))
            cut = i > 0 and (parts[i - 1]["tail"], part["head"]) not in legal
            told.append({"key": row["key"], "block": part["block"], "is_first": i == 0, "is_last": i == len(parts) - 1,
                         "end": list(end), "illegal": part["illegal"] + cut, "cost": start[0] if i == 0 else 0})
            end = start
        return told

    small = blocks.select("key", "block", "codes").mapInArrow(
        lambda b: _lists(b, shrink, shape), "key string, block bigint, costs array<bigint>, illegal bigint, head bigint, tail bigint")
    whole = small.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "costs", "illegal", "head", "tail"))).alias("parts"))
    return whole.mapInArrow(lambda b: _lists(b, chain, out),
                            "key string, block bigint, is_first boolean, is_last boolean, end array<bigint>, illegal bigint, cost bigint")


def _walked(blocks: DataFrame) -> DataFrame:
    """Each block walked from every state that it may be entered in."""
    out = pa.schema([("key", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64()),
                     ("letters", pa.list_(pa.string())), ("made", pa.list_(pa.string()))])

    def forward(row):
        entries = [0] if row["is_first"] else [0, 1, 2, 3]
        for entry, (letters, made, state) in walk(row["codes"], row["end"], entries, row["is_last"]).items():
            yield {"key": row["key"], "block": row["block"], "first": row["first"], "entry": entry, "exit": state,
                   "letters": letters, "made": made}

    return blocks.select("key", "block", "first", "codes", "is_first", "is_last", "end").mapInArrow(
        lambda b: _lists(b, forward, out),
        "key string, block bigint, first bigint, entry bigint, exit bigint, letters array<string>, made array<string>")


def _entries(walked: DataFrame) -> DataFrame:
    """(key, block, entry): the state in which the walk from the conversation's begin enters each block."""
    links = walked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "entry", "exit"))).alias("links"))
    out = pa.schema([("key", pa.string()), ("block", pa.int64()), ("entry", pa.int64())])

    def follow(row):
        state, block = 0, None
        for link in row["links"]:  # by block and entry
            if link["block"] != block and link["entry"] == state:
                yield {"key": row["key"], "block": link["block"], "entry": state}
                block, state = link["block"], link["exit"]

    return links.mapInArrow(lambda b: _lists(b, follow, out), "key string, block bigint, entry bigint")


def digests(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of ``role:text`` rows joined by line breaks; a stream of sorted rows, one digest in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            for name, row in zip(batch.column("key").to_pylist(), batch.column("row")):
                if name != key:
                    if digest:
                        done.append((key, digest.hexdigest()))
                    key, digest = name, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(row.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["key", "repaired_sha256"])
                done = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

    rows = turns.select("key", "place", "step", F.concat("role", F.lit(":"), "text").alias("row"))
    return (rows.repartition("key").sortWithinPartitions("key", "place", "step").select("key", "row")
            .mapInArrow(run, "key string, repaired_sha256 string"))


def damage(conversations: DataFrame) -> DataFrame:
    """A fixed share of rows dropped, emptied, stripped of sentence ends, repeated or given to the user, by crc32 of ``conv_id:turn``."""
    told = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    what = F.crc32(F.concat_ws(":", conversation_key(F.col("conv_id")), conversation_key(F.col("turn"))).cast("binary")) % 20
    times = F.when(what == 0, 0).when(what == 3, 2).otherwise(1)
    return told.withColumn("what", what).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select(
        "conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"))


def repair_report(originals: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row per conversation of ``originals``: faults, cost, letters and digest of its repair."""
    fixed = repair(damaged)
    keys = originals.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    met = (keys.join(fixed.verdicts, "key", "left").join(fixed.audits(), "key", "left").join(digests(fixed.turns()), "key", "left"))
    return met.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
