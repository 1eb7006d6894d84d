"""Connected components by union-find, first inside partitions, then across.

Each partition replaces its edges by a spanning forest (union-find over the
rows it holds). What is left is contracted in rounds: every label hooks onto
its smallest neighbour, chains are shortened by pointer jumping, and the edges
are rewritten to the new labels. A label that stays a root has no smaller
neighbour, so at least half of the linked labels vanish per round. All steps
are joins and ``min`` aggregates: a component of any size is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.llm.common import written


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 500_000:  # bounded memory: hand on and start anew
            yield pd.DataFrame({"a": list(parent), "b": list(parent.values())})
            parent.clear()
    yield pd.DataFrame({"a": pd.Series(list(parent), dtype="int64"),
                        "b": pd.Series(list(parent.values()), dtype="int64")})


def _roots(parent: DataFrame) -> DataFrame:
    """Pointer jumping: (x, p) with p replaced by the root of its chain."""
    while True:
        up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        nxt = written(parent.join(up, "p", "left")
                      .select("x", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        moved = nxt.filter("moved").limit(1).count()
        parent = nxt.select("x", "p")
        if not moved:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` (bigint, no nulls) -> ``(node, component)`` for every
    linked node; ``component`` is the smallest node reachable. Self-loops and
    repeated edges are harmless; no edges give an empty table."""
    cur = written(edges.select("a", "b").filter("a <> b")
                  .mapInPandas(_forest, "a bigint, b bigint")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while cur.limit(1).count():
        roots = _roots(cur.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("p")))
        if labels is None:
            labels = roots.select(F.col("x").alias("node"), F.col("p").alias("component"))
        else:
            moved = labels.join(roots, labels["component"] == roots["x"], "left")
            labels = written(moved.select("node", F.coalesce("p", "component").alias("component"))
                             .union(roots.select("x", "p").join(labels.select(F.col("node").alias("x")), "x", "left_anti")))
        to_a = roots.select(F.col("x").alias("a"), F.col("p").alias("na"))
        to_b = roots.select(F.col("x").alias("b"), F.col("p").alias("nb"))
        moved = (cur.join(to_a, "a", "left").join(to_b, "b", "left")
                 .select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")).filter("a <> b"))
        cur = written(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if labels is None:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(labels.select(F.col("component").alias("node"), "component").distinct())
