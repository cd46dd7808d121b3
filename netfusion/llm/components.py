"""Connected components of a distributed edge list by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfusion.llm.common import cut

#: Edges so few that the last rounds are spared: one task joins them.
LAST = 1 << 12


def _last_round(edges: DataFrame) -> DataFrame:
    """(u, p): of at most LAST edges each node and the least node of its component."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array([*up], pa.int64()), pa.array([top(x) for x in up], pa.int64())], names=["u", "p"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "u long, p long")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long); root is one node of the component, the same for all its nodes.

    Each round every node joins the neighbour, or itself, whose hash for that round is least, so a constant share of the nodes goes
    in a round whatever the order of ids; stars go at once. Minima are aggregated before the shuffle, hubs meet only in joins that
    Spark splits, and each round ends in a checkpoint. Once at most LAST edges are left, one task joins what they still link.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for round_ in range(max_rounds):
        n = edges.count()
        if not n:
            break
        if n <= LAST:
            parent = _last_round(edges)
        else:
            ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
            key = lambda c: F.struct(F.xxhash64(F.lit(round_), F.col(c)).alias("h"), F.col(c).alias("n"))
            parent = ends.groupBy("u").agg(F.min(key("v")).alias("m")).select("u", F.least(F.col("m"), key("u"))["n"].alias("p"))
        parent = cut(parent)
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(parent, labels.root == parent.u, "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = cut(labels)
        if n <= LAST:
            break
        pa, pb = parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), parent.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(pa, "a").join(pb, "b").where("pa <> pb")
        edges = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """connected_components() with more edges (a, b) than those that ``labels`` (node, root) come from: only the roots they link are joined."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    moved = edges.join(end("a"), "a", "left").join(end("b"), "b", "left")
    tops = connected_components(moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    top = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    new = tops.join(labels.select("node"), "node", "left_anti")
    return cut(labels.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(new))
