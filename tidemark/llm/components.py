"""Connected components of a graph of links, by union-find and alternating star contraction.

Each partition first reduces its links to stars with a union-find of its own.  Large-star and
small-star rounds then pull every node to the smallest id it can reach.  Each round is a
written table, so nothing is recomputed when an executor is lost, and no node's neighbours
are gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kit

#: Nodes that a task's union-find holds at once; it goes on with a new one then.
HELD = 500_000
#: Links for each task of a round; more tasks than Spark's own partitions there never are.
TASK = 1 << 14


def _forest(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a partition as (node, smallest node of its tree)."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars():
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([r for _, r in found], kind)], ["a", "b"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > held:
            yield stars()
            parent.clear()
    yield stars()


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one centre, and no centre is another's node."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(stars.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60, held: int = HELD) -> DataFrame:
    """(node, label) for each node of links (a, b) that isn't the smallest of its component.

    label is the smallest node reachable.  Loops and links with a null end count for nothing;
    links may repeat.
    """
    kind = links.schema["a"].dataType.simpleString()
    tasks = 1 + links.count() // TASK
    ends = links.where("a != b").select("a", "b").coalesce(tasks)
    stars = _kit.written(ends.mapInArrow(lambda batches: _forest(batches, held), f"a {kind}, b {kind}").distinct().coalesce(tasks), "stars")  # a > b
    for _ in range(most_rounds):
        if _settled(stars):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        large = _kit.written(large.coalesce(tasks), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", "low")).distinct()
        before, stars = stars, _kit.written(small.coalesce(tasks), "stars")
        _kit.dropped(before, large)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
