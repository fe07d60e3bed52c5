"""Connected components of a distributed edge list.

Every partition first replaces its edges by a spanning star forest (union-find
over that partition only).  Then alternating star steps rewrite edges towards
smaller neighbours (large star: larger neighbours of a node link to its minimum;
small star: smaller ones do) until no node is both a child and a root.  Only
(node, node) rows move; every round is a written table, and a node with very
many edges is aggregated map-side before the shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import materialize


def _forests(batches):
    """(u, v) edges to (node, smallest node it is connected with here)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    nodes = [x for x in root if find(x) != x]
    if nodes:
        yield pa.RecordBatch.from_pydict({"u": pa.array(nodes, pa.int64()),
                                          "v": pa.array([find(x) for x in nodes], pa.int64())})


def _star(directed: DataFrame, emit_larger: bool) -> DataFrame:
    """directed: (u, v) neighbours v of u.  Links every kept neighbour, and for
    the small star u itself, to the smallest of u and its neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = directed.join(least, "u")
    if emit_larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether some node is a child and a root, or a child of two roots."""
    children = edges.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    roots = edges.select(F.col("v").alias("u")).distinct()
    return not (children.filter("lo < hi").select("u").union(children.join(roots, "u", "left_semi").select("u")).isEmpty())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node that
    has an edge and is not itself the smallest.  ``edges``: (u, v) longs."""
    current = materialize(edges.select("u", "v").filter("u <> v").mapInArrow(_forests, "u long, v long"), "edges")
    while _open(current):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        current = materialize(_star(small, False).mapInArrow(_forests, "u long, v long"), "edges")
    return current.distinct().select(F.col("u").alias("node"), F.col("v").alias("root"))
