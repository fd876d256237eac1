"""Near duplicates by MinHash and an LSH forest.

A text's shingle set has a digest, a MinHash signature cut into several trees of
labels, and a 256-bit sketch for a quick similarity estimate. Texts of equal sets
are one node. Each tree is a sorted order of the nodes by their label sequence.

1. In every order a node meets its neighbours, with which it shares the longest
   prefix; so the depth of comparison follows the density of the region. Pairs whose
   lengths and sketches allow the similarity are verified on the full sets, and
   verified links form components.
2. Neighbours alone could miss a link in a dense region. So every region (equal
   prefix of the least depth) that still holds several components has all its
   members outside the region's largest component compared with all of the region
   in blocks, again by lengths, sketches, then full sets. Pairs inside a component are not needed.

So a link is missed only if no tree has both nodes in one region (at the threshold
under 6 in 10,000, less above it) or the sketch errs by almost four deviations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.buffers import LOWER, joined, pieces, word_hashes, words
from tallyvane.operators.materialize import materialize, stored

TREES, DEPTH, BITS = 16, 8, 256
_random = np.random.default_rng(2024)
FACTOR = _random.integers(0, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT = _random.integers(0, 1 << 32, BITS, dtype=np.uint32)
SKETCH_SLACK = 0.13  # near four deviations of the estimate at 0.8 to 0.85
NEIGHBOURS = 2
BLOCK_SHINGLES = 250_000


def least_depth(threshold: float) -> int:
    """Longest prefix at which some tree joins a pair at the threshold with a miss rate under 6 in 10,000."""
    return max([1, *[d for d in range(1, DEPTH) if (1 - threshold ** d) ** TREES <= 6e-4]])


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words make one, none make none."""
    for piece in pieces(column):
        begin, end, first = words(piece)
        hashes = word_hashes(piece, begin, end, LOWER)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = min(k, b - a)
            yield np.unique(joined(hashes[a:b], n) + np.uint64(n)) if n else np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(BITS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at:at + 1024, None] * FACTOR + SHIFT).min(axis=0), out=low)
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    low = (low ^ (low >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return low ^ (low >> np.uint32(16))


def signature(shingles: np.ndarray, depth: int) -> np.ndarray:
    """Longs: per tree the packed prefix and the packed rest, then four of sketch."""
    low = _minima(shingles)
    labels = low[:TREES * DEPTH].reshape(TREES, DEPTH).astype(np.int64)

    def packed(part: np.ndarray) -> np.ndarray:
        width = min(16, 60 // part.shape[1])
        out = np.zeros(TREES, np.int64)
        for i in range(part.shape[1]):
            out = out << width | part[:, i] & ((1 << width) - 1)
        return out

    sketch = np.packbits((low >> np.uint32(20) & np.uint32(1)).astype(np.uint8)).view(np.int64)
    return np.concatenate([np.stack([packed(labels[:, :depth]), packed(labels[:, depth:])], 1).reshape(-1), sketch])


def signed_rows(docs: DataFrame, k: int, depth: int) -> DataFrame:
    """doc_id, row_key, n_shingles, node (set digest, null for no words), signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node, sign = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                size.append(len(s))
                node.append(digest(s) if len(s) else None)
                sign.append(signature(s, depth) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(size, pa.int64()), pa.array(node, pa.binary()),
                 pa.array(sign, pa.list_(pa.int64()))], names=["doc_id", "row_key", "n_shingles", "node", "signature"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(
        run, "doc_id bigint, row_key string, n_shingles bigint, node binary, signature array<bigint>")


def neighbour_pairs(trees: DataFrame, threshold: int) -> DataFrame:
    """Distinct (a, b), a < b, of neighbours in the sorted orders that share a region and may be similar."""
    most = int(BITS * (1 - (threshold / 100 - SKETCH_SLACK)) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # rows at the end of the batch before
        for batch in batches:
            t = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()
            if not t:
                continue
            rows = t[0]
            last = rows.slice(max(0, rows.num_rows - NEIGHBOURS))
            node = rows.column("node")
            tree, p, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "p", "n"))
            s = np.stack([rows.column(f"s{i}").to_numpy(zero_copy_only=False) for i in range(4)], 1).view(np.uint64)
            for step in range(1, NEIGHBOURS + 1):
                if rows.num_rows <= step:
                    break
                apart = np.bitwise_count(s[:-step] ^ s[step:]).sum(axis=1)
                lo, hi = np.minimum(n[:-step], n[step:]), np.maximum(n[:-step], n[step:])
                at = np.flatnonzero((tree[:-step] == tree[step:]) & (p[:-step] == p[step:]) & (apart <= most) & (100 * lo >= threshold * hi))
                if len(at):
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), node.take(pa.array(at + step))], names=["x", "y"])

    ordered = trees.repartitionByRange("tree", "p", "q", "s0").sortWithinPartitions("tree", "p", "q", "s0", "node")
    return ordered.mapInArrow(run, "x binary, y binary").where("x != y").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def mixed_regions(nodes: DataFrame, components: DataFrame, sketch: list) -> DataFrame:
    """Rows of regions that hold several components: tree, p, node, n, sketch, c, minor (outside the largest one) and the
    shingles of the whole region (total) and of its minor rows (minor_total)."""
    labelled = nodes.join(components, "node", "left").withColumn("c", F.coalesce("component", "node"))
    rows = labelled.select("node", "n", "c", *sketch, F.posexplode(F.slice("signature", 1, 2 * TREES)).alias("tree", "p")).where("tree % 2 = 0")
    several = rows.groupBy("tree", "p").agg(F.min(F.xxhash64("c")).alias("x"), F.max(F.xxhash64("c")).alias("y")).where("x != y")
    rows = stored(rows.join(several.select("tree", "p"), ["tree", "p"], "left_semi"), "regions")
    by = rows.groupBy("tree", "p", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    mixed = by.groupBy("tree", "p").agg(F.max_by("c", F.struct("m", "c")).alias("most"), F.sum("total").alias("total"),
                                        (F.sum("total") - F.max_by("total", F.struct("m", "c"))).alias("minor_total"))
    return rows.join(mixed, ["tree", "p"]).withColumn("minor", F.col("c") != F.col("most")).drop("most")


def _block_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Every block of minor rows (side 0) beside every block of the region (side 1), sorted so that a meeting is one run of rows."""
    blocks, minor_blocks = (F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_SHINGLES)).cast("long") for c in ("total", "minor_total"))
    zero = F.lit(0).cast("long")
    whole = rows.select(*columns, F.lit(1).alias("side"), F.pmod(F.xxhash64("node"), blocks).alias("j"),
                        F.explode(F.sequence(zero, minor_blocks - 1)).alias("i"))
    part = rows.where("minor").select(*columns, F.lit(0).alias("side"), F.explode(F.sequence(zero, blocks - 1)).alias("j"),
                                      F.pmod(F.xxhash64("node"), minor_blocks).alias("i")).select(whole.columns)
    keys = ["tree", "p", "i", "j"]
    return part.unionByName(whole).repartition(*keys).sortWithinPartitions(*keys, "side", "node")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal (tree, p, i, j); at most one run waits for its end."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "p", "i", "j")]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if waiting and any(waiting[-1].column(c)[0] != batch.column(c)[a] for c in ("tree", "p", "i", "j")):
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _candidates(run: pa.Table, threshold: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(minor row, rows of other components that lengths and sketches allow) within a meeting."""
    side, n = run.column("side").to_numpy(), run.column("n").to_numpy()
    codes = run.column("c").combine_chunks().dictionary_encode()
    codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    sketch = np.stack([run.column(f"s{i}").to_numpy() for i in range(4)], 1)
    right = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0).tolist():
        y = right[(codes[right] != codes[x]) & (100 * np.minimum(n[x], n[right]) >= threshold * np.maximum(n[x], n[right]))]
        if len(y):
            y = y[np.bitwise_count((sketch[y] ^ sketch[x]).view(np.uint64)).sum(axis=1) <= most]
        if len(y):
            yield x, y


def region_links(regions: DataFrame, known: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links between different components of a region, verified on full sets.

    A region's rows are dealt into blocks of about ``BLOCK_SHINGLES`` shingles, and
    every block of rows outside the largest component meets every block of the
    region, so a task holds two blocks at a time however large the region is. The
    first pass has lengths and sketches only and finds the nodes with a possible
    partner; only those bring their full sets to the second one, and sets in ``known``
    are not made again. A pair that shares several trees is left to the first of them.
    """
    most = int(BITS * (1 - (threshold / 100 - SKETCH_SLACK)) / 2)
    light = ["tree", "p", "node", "n", "c", "minor", "s0", "s1", "s2", "s3"]

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _meetings(batches):
            found: set[int] = set()
            for x, y in _candidates(run, threshold, most):
                found.add(x)
                found.update(y.tolist())
            if found:
                yield pa.RecordBatch.from_arrays([run.column("node").combine_chunks().take(pa.array(sorted(found)))], names=["node"])

    suspects = stored(_block_rows(regions, light).mapInArrow(possible, "node binary").distinct(), "suspects")
    full = known.join(suspects, "node", "left_semi").unionByName(full_sets(suspects.join(known, "node", "left_anti"), nodes, docs, k))
    rows = regions.join(full, "node").join(nodes.select("node", "signature"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _meetings(batches):
            tree, sign = run.column("tree")[0].as_py(), np.array(run.column("signature").to_pylist(), np.int64)
            node, sets, minor = run.column("node").to_pylist(), run.column("shingles").combine_chunks(), run.column("minor").to_pylist()
            comp = run.column("c").to_pylist()
            root = {c: c for c in comp}
            out: tuple[list[bytes], list[bytes]] = ([], [])

            def find(c: bytes) -> bytes:
                while root[c] != c:
                    c = root[c]
                return c

            for x, ys in _candidates(run, threshold, most):
                mine = np.frombuffer(sets[x].as_buffer(), np.uint64)
                for y in ys[~(sign[ys, 0:tree:2] == sign[x, 0:tree:2]).any(axis=1)].tolist():
                    if minor[y] and node[y] <= node[x] or find(comp[x]) == find(comp[y]):
                        continue
                    if similar(mine, np.frombuffer(sets[y].as_buffer(), np.uint64), threshold):
                        root[find(comp[x])] = find(comp[y])
                        out[0].append(node[x])
                        out[1].append(node[y])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["a", "b"])

    return _block_rows(rows, [*light, "shingles", "signature"]).mapInArrow(compare, "a binary, b binary")


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.searchsorted(y, x).clip(0, len(y) - 1)] == x).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the whole text of one row each, as a table."""
    source = stored(nodes.join(wanted, "node").select("node", "doc_id", "row_key"), "shingle-sources")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [s.tobytes() for s in shingle_sets(part.column("text"), k)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])

    same = (F.col("d.row_key") == F.col("s.row_key")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
    texts = docs.alias("d").join(source.alias("s"), same).select("s.node", "d.text").dropDuplicates(["node"])
    return stored(texts.mapInArrow(sets, "node binary, shingles binary"), "shingle-sets")


def verified(pairs: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full shingle sets (node, shingles) reach the threshold."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold)
                             for x, y in zip(batch.column("sa"), batch.column("sb"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left = full.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = full.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a binary, b binary")


def connected(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Each round takes the smallest label among neighbours, then the label's own label,
    so chains shorten by doubling. Labels live in tables, never on the driver.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = materialize(step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = step.select("node", "component")
        if step.where("old != component").isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def contracted(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) after further links: they join whole components, so only components take part in the rounds."""
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), "component")
        more = more.join(known, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    joined_up = connected(materialize(more.where("a != b")))
    inner = labels.join(joined_up.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select(
        "node", F.coalesce("further", "component").alias("component"))
    return inner.unionByName(joined_up.join(labels, "node", "left_anti"))


def components(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept for every row of ``docs``.

    ``docs`` has doc_id and text (other columns are ignored); words are runs outside
    blank and \\t to \\r, A-Z lower-cased; ``k`` words make a shingle and texts are
    linked whose sets have 100 * intersection >= ``threshold`` * union. The component
    id is the smallest doc_id reachable by links. Rows without words are components of
    their own. ``kept`` marks the rows of that smallest doc_id; repeated rows of an id share it.
    ``row_key`` is the text's md5 (empty for null). A null doc_id is larger than any other.
    """
    depth = least_depth(threshold / 100)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.md5("text"), F.lit("")).alias("row_key"), "text")
    rows = stored(signed_rows(keyed, k, depth), "shingle-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        first, F.first("n_shingles").alias("n"), F.first("signature").alias("signature")).select("node", "first.doc_id", "first.row_key", "n", "signature")
    nodes = stored(nodes, "shingle-nodes")
    sketch = [F.element_at("signature", 2 * TREES + 1 + i).alias(f"s{i}") for i in range(4)]
    trees = (nodes.select("node", "n", *sketch, "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
             .select("tree", F.element_at("signature", 2 * F.col("tree") + 1).alias("p"), F.element_at("signature", 2 * F.col("tree") + 2).alias("q"),
                     "node", "n", *[f"s{i}" for i in range(4)]))
    near = stored(neighbour_pairs(trees, threshold), "neighbour-pairs")
    known = full_sets(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, keyed, k)
    links = stored(verified(near, known, threshold), "links")
    first = connected(links)
    regions = stored(mixed_regions(nodes, first, sketch), "mixed-regions")
    labels = contracted(first, region_links(regions, known, nodes, keyed, k, threshold))
    grouped = nodes.select("node", "doc_id", "row_key").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("f"))
    by_node = grouped.join(ids, "component").select("node", F.col("f.doc_id").alias("_id"), F.col("f.row_key").alias("keeper_key"))
    out = rows.drop("signature").join(by_node, "node", "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", "row_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("_id")).alias("component_id"),
                      F.when(alone, F.col("row_key")).otherwise(F.col("keeper_key")).alias("keeper_key")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest (doc_id, text digest); rows without words all stay.

    Texts meet the decision by (doc_id, text digest), and only keys that occur twice
    among the kept pass a deduplication of equal rows.
    """
    marked = components(docs, k, threshold)
    single = marked.where((F.col("n_shingles") > 0) & F.col("kept") & (F.col("row_key") == F.col("keeper_key")))
    keys = materialize(single.groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(F.count(F.lit(1)).alias("_n")))
    keyed = docs.withColumn("_text", F.coalesce(F.md5("text"), F.lit("")))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    worded = keyed.where(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    once = worded.join(keys.where("_n = 1"), match, "left_semi")
    repeated = worded.join(keys.where("_n > 1"), match, "left_semi").dropDuplicates(["doc_id", "_text"])
    blank = keyed.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return once.unionByName(repeated).unionByName(blank).drop("_text")
