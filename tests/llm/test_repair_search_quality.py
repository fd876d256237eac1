"""Turn repair, ranked search and the quality model against brute force and their defined edge cases."""

import functools
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyvane.llm import buffers, quality_model, queries, ranked_search, turn_repair
from tests.llm.test_operators import WORDS, prose

# 11

ROLES = ["system", "user", "assistant", "tool", ""]


def brute_repair(codes):
    """(cost, letters, made turns) by trying every edit; the least pair of cost and letters."""
    n = len(codes)

    @functools.cache
    def best(i, state, inserted):
        options = []
        if i == n and state in (0, 3):
            options.append((0, "", ""))
        goal, new = {0: (2, "U"), 1: (2, "U"), 2: (3, "A"), 3: (2, "U")}[state]
        if inserted < 3:
            c, a, m = best(i, goal, inserted + 1)
            options.append((c + 3, "I" + a, new + m))
        if i < n:
            fault, role = divmod(codes[i], 4)
            c, a, m = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, m))
            if fault < 2:
                if state == 0 and role == 0:
                    c, a, m = best(i + 1, 1, 0)
                    options.append((c + 3 * fault, "K" + a, "k" + m))
                c, a, m = best(i + 1, goal, 0)
                if role == goal - 1:
                    options.append((c + 3 * fault, "K" + a, "k" + m))
                options.append((c + 3 * fault + 3, "R" + a, new.lower() + m))
        return min(options, default=(10 ** 9, "", ""))

    return best(0, 0, 0)


def test_walk_equals_brute_force_in_one_block_and_in_many():
    rng = random.Random(11)
    for _ in range(400):
        codes = [rng.randrange(12) for _ in range(rng.randrange(12))]
        cost, letters, made = brute_repair(tuple(codes))
        if not codes:
            continue
        pieces, at = [], 0
        while at < len(codes):
            size = rng.randint(1, 4)
            pieces.append(codes[at:at + size])
            at += size
        ends = [turn_repair.END]
        for piece in reversed(pieces):
            m = turn_repair.matrix(piece)
            ends.append(tuple(min(m[4 * s + x] + ends[-1][x] for x in range(4)) for s in range(4)))
        ends.reverse()
        state, told, turns = 0, "", ""
        for i, piece in enumerate(pieces):
            walked = turn_repair.walk(piece, ends[i + 1], [0, 1, 2, 3], i == len(pieces) - 1)
            a, b, state = walked[state]
            told, turns = told + "".join(a), turns + "".join(b)
        assert (ends[0][0], told, turns) == (cost, letters, made)
        whole = turn_repair.walk(codes, turn_repair.END, [0], True)[0]
        assert ("".join(whole[0]), "".join(whole[1])) == (letters, made)


def brute_report(rows):
    """The report's columns for rows of one conversation (after damage)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, codes, faults = set(), [], Counter()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        codes.append(4 * {None: 0, "truncated": 1}.get(fault, 2) + {"s": 0, "u": 1, "a": 2}.get(role[:1], 3))
    cost, audit, made = brute_repair(tuple(codes))
    turns = [t for t, *_ in rows if t is not None]
    out, at, told = [], 0, iter(audit)
    for m in made:
        op = next(told)
        while op == "D":
            at, op = at + 1, next(told)
        if op == "I":
            out.append("user:" if m == "U" else "assistant:")
        else:
            _, role, text = rows[at]
            out.append(f"{role if m == 'k' else 'user' if m == 'u' else 'assistant'}:{text}")
            at += 1
    initials = [r[1][:1] for r in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults["blank"], "duplicate": faults["duplicate"],
            "truncated": faults["truncated"], "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))}


@pytest.mark.parametrize("bits", [1, 12])
def test_repair_report_with_small_and_large_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", bits)
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \t", "Why?", "so . ", "é!", "z" * 30_000]
    rows = [(c, rng.choice([None, 0, 1, 2, 2, 5]), rng.choice([*ROLES, None]), rng.choice([*texts, None])) for c in (1, 2, 3, 4, 5, None)
            for _ in range(rng.randrange(1, 9))]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("place", F.lit("clash"))
    originals = df.unionByName(spark.createDataFrame([(77, 0, "user", "x", "c")], df.schema))
    got = {r["conv_id"]: r.asDict() for r in turn_repair.repair_report(originals, df).collect()}
    told = {}
    for c, *row in rows:
        told.setdefault(c, []).append((row[0], *(" " if x is None else x for x in row[1:])))
    assert set(got) == {*told, 77}
    for c, mine in told.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == brute_report(mine), (c, mine)
    assert got[77]["audit"] == "" and got[77]["cost"] == 0 and got[77]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert turn_repair.repair_report(originals.limit(0), df.limit(0)).count() == 0


def test_repaired_turns_are_right(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a."), (1, 1, "user", "cut"), (1, 2, "tool", "t.")], "conv_id bigint, turn bigint, role string, text string")
    fixed = turn_repair.repair(df)
    turns = [(r["role"], r["text"]) for r in fixed.turns().orderBy("place", "step").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in turns))
    assert fixed.verdicts.first()["cost"] == brute_repair((2, 5, 3))[0]


# 12

def brute_search(docs, items, k):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())
    held = [(d, Counter(split(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        ranked = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if s:
                ranked.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [50, 600_000])
def test_search_equals_brute_force(spark, documents, monkeypatch, postings):
    monkeypatch.setattr(ranked_search, "PART_POSTINGS", postings)
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(1, 40))) for i in range(150)] + [(200 + i, "ba da hot copy") for i in range(40)]
    rows += [(7, None), (8, ""), (9, "... --"), (None, rows[3][1]), (None, "hot"), rows[5], rows[5], (500, prose(rng, 20_000)), (501, "É éa HOT")]
    items = [(i, prose(rng, rng.randint(1, 25))) for i in range(12)] + [(50, None), (51, "?!"), (52, "hot hot copy"), (52, "hot hot copy"),
                                                                         (53, "unheard"), (None, "éA hot")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(rows).withColumn("n", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = sorted((tuple(r) for r in ranked_search.search(docs, asked, 5).collect()), key=str)
    assert got == brute_search(rows, items, 5)
    assert ranked_search.search(documents([]), asked).count() == 0
    assert ranked_search.search(docs, asked.limit(0)).count() == 0


def test_items_in_several_passes(spark, documents, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 60)
    rng = random.Random(13)
    rows, items = [(i, prose(rng, 15)) for i in range(60)], [(i, prose(rng, 5)) for i in range(9)]
    got = ranked_search.search(documents(rows), spark.createDataFrame(items, "item_id bigint, text string"), 3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_search(rows, items, 3)


def test_intervals_are_left_out_and_the_best_still_found():
    rng = np.random.default_rng(4)
    n_docs, n_terms = 20_000, 40
    term = np.repeat(np.arange(n_terms), 2_000)
    doc = np.concatenate([np.sort(rng.choice(n_docs, 2_000, replace=False)) for _ in range(n_terms)])
    impact = (rng.pareto(1.2, len(term)) * 1000).astype(np.int64) + 1
    items = ranked_search.Items(np.zeros(0, np.uint64), np.array([0, 3, 3, 8]), np.array([1, 5, 9, 0, 2, 4, 30, 39]), np.array([1, 2, 1, 1, 1, 3, 1, 1]))
    part, seen = ranked_search.Part(n_docs, term, doc, impact), {}
    item, found, score = ranked_search.best_first(part, items, 10, np.zeros(3, np.int64), seen)
    for i in (0, 2):
        total = np.zeros(n_docs, np.int64)
        for t, w in zip(items.term[items.start[i]:items.start[i + 1]], items.times[items.start[i]:items.start[i + 1]]):
            np.add.at(total, doc[term == t], w * impact[term == t])
        want = sorted(zip(-total, range(n_docs)))[:10]
        assert list(zip(-score[item == i], found[item == i])) == want
    assert not (item == 1).any() and seen["scored"] < 2_000  # of 16,000 postings


# 13

def junk(rng):
    return " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(40)) if rng.random() < 0.5 else "x | " * 30


def quality_rows(rng, n):
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        rows.append((i, ". ".join(prose(rng, 9).capitalize() for _ in range(6)) if good else junk(rng), good))
    return rows


def test_quality_from_positives_only(spark, documents):
    rng = random.Random(13)
    rows = quality_rows(rng, 600)
    trusted = spark.createDataFrame([(i,) for i, _, good in rows if good and i % 2], "doc_id bigint")
    docs = documents([(i, t) for i, t, _ in rows])
    model = quality_model.fit(docs, trusted, rounds=40)
    assert 0.6 < model.prior < 0.85
    fresh = quality_rows(rng, 200) + [(900, None, None), (901, "", None), (902, "w" * 50_000, None), (903, "one", None), (903, "one", None)]
    out = quality_model.score(documents([r[:2] for r in fresh]).withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == len(fresh) and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: good for i, _, good in fresh}
    right = [truth[r["doc_id"]] == (r["score"] >= 0.5) for r in out if truth[r["doc_id"]] is not None]
    assert sum(right) >= 0.97 * len(right)
    assert "source" in out[0].asDict() and out[-1]["score"] == out[-2]["score"]
    assert quality_model.score(documents([]), model).count() == 0
    nobody = quality_model.fit(docs, trusted.limit(0))
    assert {r["score"] for r in quality_model.score(docs, nobody).collect()} == {0.5}


def test_risk_sums_and_calibration(spark, documents):
    rng = random.Random(14)
    rows = quality_rows(rng, 80)
    docs, trusted = documents([r[:2] for r in rows]), spark.createDataFrame([(i,) for i, _, good in rows if good], "doc_id bigint")
    drawn = quality_model.sample(docs, trusted, 50, 60)
    assert {r["kind"]: r["n"] for r in drawn.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        1: min(50, sum(g for *_, g in rows)), 0: 60}
    weights = np.random.default_rng(0).normal(size=quality_model.SIZE)
    got = quality_model._sums(quality_model._vectors(drawn), weights, (0, 1, 2, 3))
    margins = {0: [], 1: []}
    for r in drawn.collect():
        (piece,) = buffers.pieces(pa.array([r["text"]]))
        _, index, value = quality_model.features(piece)
        margins[r["kind"]].append(float(weights[index] @ value.astype(np.float32)))
    for k in (0, 1):
        f = np.array(margins[k])
        assert np.allclose(got["loss"][k], [np.logaddexp(0, -f).mean(), np.logaddexp(0, f).mean()], atol=1e-5)
    knots, values = quality_model.calibrate(np.array([3.0, 2, 1, 0]), np.array([5, 4, 1, 0]), np.array([4, 5, 3, 8]), 0.5)
    assert (np.diff(values) >= 0).all() and values[0] == 0 and (np.diff(knots) > 0).all()


def test_registered_queries_run_on_small_tables(spark, documents, as_folder):
    rng = random.Random(15)
    rows = quality_rows(rng, 120)
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows if i % 2], "doc_id bigint, quality int, toxic int")
    out = queries.op13_quality_model(spark, as_folder(documents=documents([r[:2] for r in rows]), labels=labels)).collect()
    assert len(out) == 120 and {r["predicted"] for r in out} <= {0, 1} and any(r["held_out"] for r in out)
