"""Connected components of a link table by alternating star contractions.

Each round points neighbours at the smallest node they know, once seen from the larger
and once from the smaller side; the number of rounds grows with the logarithm of the
longest chain. Links that join nothing new within a task are left out beforehand, as the
components are the same without them. A hub's links are never gathered: minima are partial aggregates, and the
join that carries them back may be split where it is skewed. Every round is written to
the shared folder, so nothing is recomputed after a loss.
"""

from __future__ import annotations

import pyarrow as pa
from framesift.session import store
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 100
#: Nodes that a task remembers while it looks for needless links; it forgets all beyond that.
FOREST_NODES = 1 << 19


def _forest(batches):
    """The links of a task without those between nodes that its earlier links connect."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = top(a), top(b)
            keep.append(a != b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        yield batch.filter(pa.array(keep, pa.bool_()))
        if len(parent) > FOREST_NODES:
            parent.clear()


def _to_minimum(edges: DataFrame) -> DataFrame:
    """u, v, m: each edge with the smallest of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` but the roots; root is the smallest node."""
    links = links.select("a", "b").mapInArrow(_forest, "a bigint, b bigint")
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        now = _state(edges)
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _to_minimum(large)
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").filter("u <> v").distinct()
        edges = store(small, "stars")
    raise RuntimeError("components did not settle")
