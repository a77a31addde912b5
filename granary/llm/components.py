"""Connected components by union-find over edge blocks, then distributed contraction.

No step brings edges or labels to the driver; only counts come back. Each round writes its table to the
shared folder, so a lost executor costs one round at most."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import parts_for, written

#: Edges that one task unites in memory.
BLOCK = 500_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a block's edges by one edge from each node to the smallest of its group there."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    schema = None
    for b in batches:
        schema = schema or b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            a, c = find(x), find(y)
            if a != c:
                parent[max(a, c)] = min(a, c)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([find(x) for x in nodes], schema.field(1).type)], schema=schema)


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) for every node of ``edges`` (its first two columns); root is the group's smallest node.

    Loops and repeated edges change nothing; without edges there are no rows. Each round unites blocks of
    edges locally, which leaves forests; where more than one block remains, every node then takes its
    smallest neighbour, chains are halved until they are flat, and the groups so found are contracted."""
    a, b = edges.columns[:2]
    e = written(edges.select(F.col(a).alias("node"), F.col(b).alias("root")).filter("node is not null and root is not null"), "edges")
    result = None
    while True:
        n = e.count()
        parts = parts_for(n, block)
        forest = written(e.repartition(parts).mapInArrow(_unite, e.schema), "forest")
        if parts == 1:
            step = forest
        else:
            both = forest.union(forest.select("root", "node"))
            step = written(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("root")), "step")
            while True:
                up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
                jumped = written(step.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jump")
                step = jumped.select("node", "root")
                if jumped.filter("moved").isEmpty():
                    break
        if result is None:
            result = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
            result = written(result.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        if parts == 1:
            return result
        to = step.select(F.col("node").alias("k"), F.col("root").alias("r"))
        e = written(
            forest.join(to, F.col("node") == F.col("k")).select(F.col("r").alias("node"), "root")
            .join(to, F.col("root") == F.col("k")).select("node", F.col("r").alias("root")).filter("node <> root").distinct(),
            "edges",
        )
