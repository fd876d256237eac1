"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents with the same set of sources form a pattern; Spark sums rows and tokens
per pattern. In the network every pattern gets its tokens once for each allowed
repetition, at a cost that rises with the repetition (convex), patterns feed the
sources they belong to, and sources take up to their quota. The cheapest largest
flow says how many tokens of each repetition go to each source. Inside a pattern,
documents stand in a seeded order, and a repetition takes those whose middle lies
within its tokens: whole documents, within half a document of the flow.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import with_running_total


def capped_targets(sizes: dict[str | None, int], weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> dict[str | None, float]:
    """Target tokens per source: weights in code point order of the names (null last), repeated as needed.

    The sum of all sizes is shared by weight; a target stops at ``max_repeats`` times
    its source's size and the excess is shared again among the others.
    """
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, target = float(sum(sizes.values())), list(names), {}
    while free:
        unit = left / sum(weight[n] for n in free)
        full = [n for n in free if unit * weight[n] > max_repeats * sizes[n]]
        if not full:
            target |= {n: unit * weight[n] for n in free}
            break
        for n in full:
            target[n] = float(max_repeats * sizes[n])
            left -= target[n]
        free = [n for n in free if n not in target]
    return target


@dataclass
class Arc:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(tokens: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], max_repeats: int = 3) -> list[list[int]]:
    """Tokens from each pattern to each source in a cheapest largest flow.

    Repetition r of a pattern's tokens costs r * r. Successive shortest paths with
    Dijkstra over reduced costs; the network has a node per pattern and source.
    """
    n, m = len(tokens), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[Arc]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(Arc(b, room, cost, len(graph[b])))
        graph[b].append(Arc(a, 0, -cost, len(graph[a]) - 1))

    for p in range(n):
        for r in range(max_repeats):
            arc(start, p, tokens[p], (r + 1) ** 2)
        for s in members[p]:
            arc(p, n + s, max_repeats * tokens[p], 0)
    for s in range(m):
        arc(n + s, end, quotas[s], 0)
    height = [0] * len(graph)
    while True:
        far: list[float] = [float("inf")] * len(graph)
        far[start], came, queue = 0, {}, [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for i, x in enumerate(graph[a]):
                if x.room > 0 and (to := d + x.cost + height[a] - height[x.to]) < far[x.to]:
                    far[x.to], came[x.to] = to, (a, i)
                    heapq.heappush(queue, (to, x.to))
        if far[end] == float("inf"):
            break
        height = [h + (f if f < float("inf") else far[end]) for h, f in zip(height, far)]
        path, node = [], end
        while node != start:
            a, i = came[node]
            path.append(graph[a][i])
            node = a
        flow = min(x.room for x in path)
        for x in path:
            x.room -= flow
            graph[x.to][x.back].room += flow
    out = [[0] * m for _ in range(n)]
    for p in range(n):
        for x in graph[p]:
            if n <= x.to < n + m:
                out[p][x.to - n] = graph[x.to][x.back].room
    return out


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, seed: str = "", max_patterns: int = 50_000) -> DataFrame:
    """The rows of ``docs`` with source_size, target, repeats, taken and routes.

    ``docs`` has doc_id, size (tokens, null: 0) and sources, an array of the names of
    the sources that hold the document; a null name is a source of its own, a null
    or empty array means that one, repeated names count once. ``source_size`` and ``target`` are those of the
    first source; ``repeats`` says how often the whole document is taken, ``taken``
    is repeats * size, ``routes`` names the source of each repetition. The seeded
    order is by md5 of seed and doc_id, then by size; equal rows are interchangeable.
    Documents of size 0 are taken 0 times. The pattern table is solved on the driver:
    it has a row per distinct set of sources, and more than ``max_patterns`` are
    refused. Columns of the added names are replaced.
    """
    spark = docs.sparkSession
    names = F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, F.array_sort(F.array_distinct("sources"))).otherwise(F.array(F.lit(None).cast("string")))
    rows = docs.drop("source_size", "target", "repeats", "taken", "routes", "_pattern", "_names", "_digest").withColumns({
        "size": F.coalesce(F.col("size").cast("long"), F.lit(0)), "_names": names,
        "_digest": F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))})
    rows = rows.withColumn("_pattern", F.to_json("_names"))
    patterns = sorted(rows.groupBy("_pattern", "_names").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t")).take(max_patterns + 1),
                      key=lambda r: r["_pattern"])
    if len(patterns) > max_patterns:
        raise ValueError(f"more than {max_patterns} distinct sets of sources")
    sizes: dict[str | None, int] = {}
    for r in patterns:
        for name in r["_names"]:
            sizes[name] = sizes.get(name, 0) + r["t"]
    # a document in several sources is shared out once
    total = sum(r["t"] for r in patterns)
    scale = total / max(1, sum(sizes.values()))
    target = capped_targets(sizes, weights, max_repeats)
    order = list(target)
    quotas = [round(target[s] * scale) for s in order]
    flow = min_cost_flow([r["t"] for r in patterns], [[order.index(s) for s in r["_names"]] for r in patterns], quotas, max_repeats)
    table = []
    for r, row in zip(patterns, flow):
        cuts, routed, at = [], [], 0
        for s, tokens in zip(order, row):
            if tokens:
                at += tokens
                cuts.append(at)
                routed.append(s)
        first = r["_names"][0]
        table.append((r["_pattern"], r["t"], cuts, routed, sizes[first], float(target[first])))
    plan = spark.createDataFrame(table, "_pattern string, _tokens bigint, _cuts array<bigint>, _routed array<string>, source_size bigint, target double")
    placed = with_running_total(rows, "_pattern", "_digest", ["size"], F.col("size"), max((r["n"] for r in patterns), default=0), "_before")
    placed = placed.join(plan, "_pattern")
    # position of the document's middle in each repetition, doubled to stay whole
    middle = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda r: 2 * (F.col("_before") + r * F.col("_tokens")) + F.col("size"))
    within = F.filter(middle, lambda p: (F.col("size") > 0) & (p <= 2 * F.coalesce(F.array_max("_cuts"), F.lit(0))))
    routes = F.transform(within, lambda p: F.element_at("_routed", F.size(F.filter("_cuts", lambda c: 2 * c < p)) + 1))
    return (placed.withColumn("routes", routes).withColumn("repeats", F.size("routes"))
            .withColumn("taken", F.col("repeats") * F.col("size"))
            .drop("_pattern", "_names", "_digest", "_before", "_tokens", "_cuts", "_routed"))
