"""Benchmark decontamination by random-walk embedding, bit-sampling LSH and exact edit distance.

Texts and items are sequences of lower-cased (Unicode) words without ASCII punctuation. The
CGK walk reads a sequence and at each step writes the current word and advances or
not, as a random function of (step, word) says; walks of two sequences at small edit
distance fall into step again, so edit distance becomes Hamming distance. An LSH
key samples a few steps of a walk; walk and sample are drawn anew for each of the
repetitions, whose number is set from measured collision rates at the largest
allowed distance so that the target recall is reached. Every item-sized window of
every text, one at each word, is looked up. A window that shares fewer word pairs with the
items than an edit within the limit could leave (the q-gram lemma) can't match and
isn't walked. Colliding (window, item) pairs are verified by exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.buffers import SPACE, U, joined, mix, pieces, word_hashes, words

LEAST_WORDS = 4  # shorter items are no evidence of a leak and are left out
#: ASCII punctuation and white space separate words; other bytes outside ASCII are letters here
BREAK = np.array([SPACE[b] or b < 128 and not chr(b).isalnum() for b in range(256)])
END = U(0x5851F42D4C957F2D)


def word_sequences(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each text and the end) for each piece of a text column."""
    for piece in pieces(pc.utf8_lower(column)):
        begin, end, first = words(piece, space=BREAK)
        yield piece.first, word_hashes(piece, begin, end), first


def edit_search(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end): least edit distance of the item to any stretch of text, and where the first best stretch ends.

    Bit-parallel columns over the item's words.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score = full, 0, n
    best, at = n, 0
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, at = score, j
    return best, at


@dataclass
class ItemClass:
    """Items of ``least`` to ``most`` words with their walks and LSH tables."""

    least: int
    most: int
    items: list[int]
    pairs_needed: int
    steps: int
    sampled: list[list[int]] = field(default_factory=list)
    walk_keys: list[np.ndarray] = field(default_factory=list)
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def walk(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, turn: int) -> np.ndarray:
        """LSH keys of the windows that begin at ``starts`` (and can't read past ``ends``)."""
        at, key, sampled = starts.copy(), np.zeros(len(starts), U), set(self.sampled[turn])
        padded = np.append(hashes, END)
        for j in range(max(sampled) + 1):
            word = padded[np.where(at < ends, at, len(hashes))]
            if j in sampled:
                key = key * U(0xD6E8FEB86659FD93) + word
            at += (mix(word ^ self.walk_keys[turn][j]) & U(1)).astype(np.int64)
        return mix(key)


@dataclass
class Matcher:
    """Everything needed to search texts for one block of items."""

    ids: list
    items: list[np.ndarray]
    limits: list[int]
    pairs: np.ndarray
    seen: np.ndarray
    classes: list[ItemClass]

    def find(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, last word) of every item within its limit, best stretch of each text."""
        if len(hashes) < 2 or not self.items:
            return []
        pair = joined(hashes, 2)
        known = self.seen[(pair >> U(44)).astype(np.int64)]
        at = np.flatnonzero(known)
        known[at] = self.pairs[np.searchsorted(self.pairs, pair[at]).clip(0, len(self.pairs) - 1)] == pair[at]
        edges = first[1:-1][(first[1:-1] > 0) & (first[1:-1] <= len(pair))] - 1
        known[edges] = False  # no pair across texts
        total = np.append(0, np.cumsum(known))
        owner_end = np.repeat(first[1:], np.diff(first))
        found: dict[tuple[int, int], list[int]] = {}
        n = len(hashes)
        for c in self.classes:
            start = np.arange(n)
            last = np.minimum(np.minimum(start + c.least, owner_end) - 1, n - 1)
            start = np.flatnonzero(total[last] - total[start] >= c.pairs_needed)
            if not len(start):
                continue
            end = owner_end[start]
            for turn, (keys, owners) in enumerate(c.tables):
                key = c.walk(hashes, start, end, turn)
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for w in np.flatnonzero(hi > lo).tolist():
                    for item in owners[lo[w]:hi[w]].tolist():
                        found.setdefault((int(np.searchsorted(first, start[w], "right")) - 1, item), []).append(int(start[w]))
        out = []
        for (text, item), starts in found.items():
            hit = self._verify(hashes, sorted(set(starts)), int(first[text]), int(first[text + 1]), item)
            if hit:
                out.append((text, item, hit[0], hit[1] - int(first[text]), hit[2] - int(first[text])))
        return out

    def _verify(self, hashes: np.ndarray, starts: list[int], low: int, high: int, item: int) -> tuple[int, int, int] | None:
        """Best stretch in the regions around the window starts, if within the item's limit."""
        wanted, limit = self.items[item].tolist(), self.limits[item]
        best = None
        i = 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= len(wanted):
                j += 1
            a, b = max(low, starts[i]), min(high, starts[j] + len(wanted) + limit)
            distance, end = edit_search(wanted, hashes[a:b].tolist())
            if distance <= limit and (best is None or distance < best[0]):
                back = hashes[max(a, a + end - len(wanted) - limit):a + end].tolist()
                _, length = edit_search(wanted[::-1], back[::-1])
                best = (distance, a + end - length, a + end)
            i = j + 1
        return best


def build(rows: list[tuple], max_edit: float = 0.2, recall: float = 0.98, sample: int = 2, seed: int = 5) -> Matcher:
    """A matcher for items (item_id, text); an item's limit is ``max_edit`` times its words, rounded down."""
    ids, items = [], []
    for at, hashes, first in word_sequences(pa.array([r[1] for r in rows], pa.large_string())):
        for i in range(len(first) - 1):
            if first[i + 1] - first[i] >= LEAST_WORDS:
                ids.append(rows[at + i][0])
                items.append(hashes[first[i]:first[i + 1]].copy())
    limits = [int(max_edit * len(x)) for x in items]
    pairs = np.unique(np.concatenate([joined(x, 2) for x in items])) if items else np.zeros(0, U)
    seen = np.zeros(1 << 20, bool)
    seen[(pairs >> U(44)).astype(np.int64)] = True
    rng = np.random.default_rng(seed)
    classes, order, i = [], sorted(range(len(items)), key=lambda x: (len(items[x]), x)), 0
    while i < len(order):
        least = len(items[order[i]])
        j = i
        while j < len(order) and len(items[order[j]]) <= 1.25 * least:
            j += 1
        most = len(items[order[j - 1]])
        c = ItemClass(least, most, order[i:j], max(1, least - 1 - 2 * int(max_edit * most)), max(sample, int(1.5 * least)))
        _draw(c, items, limits, recall, sample, rng)
        classes.append(c)
        i = j
    return Matcher(ids, items, limits, pairs, seen, classes)


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        at, kind, fresh = int(rng.integers(0, len(out))), int(rng.integers(0, 3)), int(rng.integers(0, 1 << 63))
        out[at:at + (kind != 1)] = [] if kind == 2 and len(out) > 1 else [fresh]
    return np.array(out, U)


def _draw(c: ItemClass, items: list[np.ndarray], limits: list[int], recall: float, sample: int, rng: np.random.Generator) -> None:
    """Draw walks until edited copies of the items, at the limit, collide with the wanted recall."""
    chosen = c.items[:: max(1, len(c.items) // 200)]
    probes = [(x, _edited(items[x], limits[x], rng)) for x in chosen for _ in range(max(1, 200 // len(chosen)))]
    edited = np.concatenate([p for _, p in probes])
    ends = np.cumsum([len(p) for _, p in probes])
    starts = np.append(0, ends[:-1])
    own = np.concatenate([items[x] for x in c.items])
    own_end = np.cumsum([len(items[x]) for x in c.items])
    own_start = np.append(0, own_end[:-1])
    place = {x: i for i, x in enumerate(c.items)}
    target = np.array([place[x] for x, _ in probes])
    met = np.zeros(len(probes), bool)
    while True:
        turn = len(c.tables)
        c.sampled.append(sorted(rng.choice(c.steps, sample, replace=False).tolist()))
        c.walk_keys.append(rng.integers(0, 1 << 63, c.steps, dtype=np.int64).astype(U))
        keys = c.walk(own, own_start, own_end, turn)
        met |= c.walk(edited, starts, ends, turn) == keys[target]
        by = np.argsort(keys, kind="stable")
        c.tables.append((keys[by], np.array(c.items)[by]))
        if turn >= 11 and met.mean() >= recall or turn >= 255:
            return


def matchers(benchmark: DataFrame, items_per_block: int = 20_000, max_edit: float = 0.2, recall: float = 0.98) -> Iterator[Matcher]:
    """Matchers for blocks of about ``items_per_block`` items each, so what travels to tasks stays bounded. Null texts are no items."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    blocks = -(-items.count() // items_per_block)
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if block:
            yield build([tuple(r) for r in block], max_edit, recall)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, distance, item_words, first_word, last_word: each item that a text holds within the limit.

    ``docs`` has doc_id and text, ``benchmark`` item_id (bigint) and text; other
    columns are ignored. The best stretch per row and item is returned, as word positions
    (last exclusive). Null and empty texts hold nothing; repeated rows each give theirs; an
    empty benchmark gives no rows. Several blocks of items mean several passes over the texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "item_id", "distance", "item_words", "first_word", "last_word"]
    schema = ", ".join(f"{c} bigint" for c in names)

    def search(matcher: Matcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, out = batch.column("doc_id").to_pylist(), []
                for at, hashes, first in word_sequences(batch.column("text")):
                    out += [(ids[at + text], matcher.ids[item], d, len(matcher.items[item]), a, b)
                            for text, item, d, a, b in matcher.find(hashes, first)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
        return run

    parts = [rows.mapInArrow(search(m), schema) for m in matchers(benchmark, **options)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, whose texts hold no benchmark item. Only the text goes to Python and only the decision comes back."""
    def clean(matcher: Matcher):
        @F.arrow_udf("boolean")
        def free(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in texts:
                clean = np.ones(len(column), bool)
                for at, hashes, first in word_sequences(column):
                    for text, *_ in matcher.find(hashes, first):
                        clean[at + text] = False
                yield pa.array(clean)

        return free

    for m in matchers(benchmark, **options):
        docs = docs.where(clean(m)("text"))
    return docs
