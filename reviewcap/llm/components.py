"""Connected components by alternating stars, as joins and grouped minima.

Before the first round each task turns the links it holds into stars, a bounded
number of nodes at a time, so that the rounds start with at most one edge a
node and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

NODES = 1 << 18  # that a task holds at once


def _stars(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v from links a, b: each node with the lowest it reaches by the links at hand."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    def found() -> pa.RecordBatch:
        edges = [(x, low) for x in above if (low := root(x)) != x]
        above.clear()
        return pa.record_batch([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
            if len(above) >= NODES:
                yield found()
    yield found()


def _lowest(edges: DataFrame) -> DataFrame:
    """u, v of ``edges`` with the smallest neighbour of u (or u) as ``low``."""
    # Joining on the digest too deals out both sides anew, so that Spark can split the rows of a node with many edges.
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"), F.xxhash64("u").alias("digest"))
    return edges.withColumn("digest", F.xxhash64("u")).join(low, ["digest", "u"]).select("u", "v", "low")


def components(links: DataFrame) -> DataFrame:
    """v, component (the smallest node it reaches) for every node of the links a, b (longs, a <> b)."""
    edges = stored(links.select("a", "b").mapInArrow(_stars, "u long, v long").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        near = _lowest(large)
        small = near.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(near.select("u", F.col("low").alias("v")))
        edges = stored(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(
        edges.select("v", F.col("v").alias("component")).distinct()).groupBy("v").agg(F.min("component").alias("component"))
