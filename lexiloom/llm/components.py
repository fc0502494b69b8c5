"""Connected components without a driver: union-find inside tasks, then alternating stars between them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

#: Edges that one task joins in memory.
EDGES_PER_TASK = 200_000


def _union(batches):
    """Joins the edges of one task; each node then points at the least node that it reaches there."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[p]
        return x

    for b in batches:
        for a, c in zip(b["child"], b["parent"]):
            a, c = root(a), root(c)
            if a != c:
                parent[max(a, c)] = min(a, c)
    pairs = [(x, root(x)) for x in list(parent)]
    yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["child", "parent"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (child, parent): the component is its least node, which is its own.

    Edges may come in either direction and repeat; loops are ignored. Tasks of EDGES_PER_TASK edges join what they hold; between tasks, if there
    are several, large and small stars alternate until nothing changes. Every step writes edges of the order of the nodes. The result is checkpointed.
    """
    prepare(edges.sparkSession)
    shape = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in ("child", "parent"))
    edges = cut(edges.select("child", "parent").where("child != parent").distinct())
    tasks = -(-edges.count() // EDGES_PER_TASK)
    now = cut((edges.coalesce(1) if tasks <= 1 else edges.repartition(tasks)).mapInPandas(_union, shape).distinct())
    seen = None
    while tasks > 1:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        least = both.groupBy("child").agg(F.min("parent").alias("m")).select("child", F.least("m", "child").alias("m"))
        large = both.join(least, "child").where(F.col("parent") > F.col("child")).select(F.col("parent").alias("child"), F.col("m").alias("parent")).distinct()
        small = large.groupBy("child").agg(F.min("parent").alias("m"))
        moved = large.join(small, "child").where(F.col("parent") != F.col("m")).select(F.col("parent").alias("child"), F.col("m").alias("parent"))
        now = cut(moved.unionByName(small.select("child", F.col("m").alias("parent"))).distinct())
    roots = now.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(roots)
