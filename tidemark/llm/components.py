"""Connected components by rounds of union-find inside partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

EDGES = 400_000  # that one task joins at most, about


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges' nodes, each with the smallest node it reaches by the edges of this partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``, both long; component is the smallest node reachable.

    ``edges`` is counted first, so it should be a written table. A round gives each task up to about ``EDGES`` edges to join
    by union-find, which leaves one row for each node and task however hot the node is. If more than one task was needed,
    their answers meet by node: nodes with more than one answer turn into edges between those roots for the next round,
    and without any the labels are final. Null ends are left out; no edges, no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    while True:
        tasks = max(1, math.ceil(edges.count() / EDGES))
        answers = stage(edges.coalesce(tasks).mapInArrow(_forest, "node long, component long"), "forest")
        if tasks == 1:
            return answers
        least = stage(answers.groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("most")), "least")
        torn_nodes = least.where("component <> most")
        if torn_nodes.isEmpty():
            return least.select("node", "component")
        kept = least.select(F.col("node").alias("a"), F.col("component").alias("b"))
        torn = answers.withColumnRenamed("component", "root").join(torn_nodes, "node").where("root <> component").select(F.col("root").alias("a"), F.col("component").alias("b"))
        edges = stage(kept.union(torn).distinct().repartition("b", F.pmod("a", F.lit(16))), "edges")
