"""Connected components of an undirected edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


#: Vertices with more than this many edges, and over 1 in HUBS of all, are hubs: at most HUBS of them, whose least neighbours are broadcast.
HUB, HUBS = 256, 16_384


def _with_least(rows: DataFrame, itself: bool) -> tuple[DataFrame, DataFrame, str]:
    """(``rows`` with m, the least v (or the vertex itself) around each u; (u, m); the path of that table).

    The edges of a hub stay where they are and meet its m by broadcast, so that no task gathers them; the others go by key.
    """
    spark = rows.sparkSession
    found = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    found = found.select("u", (F.least("u", "m") if itself else F.col("m")).alias("m"), "n")
    least, path = materialize(found, "cc-least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(HUB, total // HUBS)
    hubs = least.where(F.col("n") > bound).select("u", "m").collect()  # HUBS rows at most
    if not hubs:
        return rows.join(least.select("u", "m"), "u"), least.select("u", "m"), path
    table = F.broadcast(spark.createDataFrame(hubs, "u long, m long"))
    light = rows.join(table.select("u"), "u", "left_anti").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return rows.join(table, "u").unionByName(light), least.select("u", "m"), path


def _large_star(e: DataFrame) -> tuple[DataFrame, str]:
    """Every larger neighbour of a vertex moves to the least vertex around it; and a table to remove afterwards."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    j, _, path = _with_least(both, True)
    return j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), path


def _small_star(e: DataFrame) -> tuple[DataFrame, str]:
    """Every smaller neighbour of a vertex, and itself, moves to the least of them; and a table to remove afterwards."""
    j, least, path = _with_least(e, False)
    moved = j.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), path


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex that has an edge; component is the least id reachable.

    Large-star and small-star rounds (Kiveris et al., 2014) take O(log^2 n) rounds. Each half round
    is an aggregation with map-side combine and a join, in which hubs meet a broadcast of bounded size,
    and ends in a written table, so that a lost executor costs one half round. Null
    ends and loops are ignored; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e, path = materialize(start, "cc")
    state = None
    while True:
        for half in (_large_star, _small_star):
            moved, table = half(e)
            after, new = materialize(moved, "cc")
            for old in (path, table):
                remove(spark, old)
            e, path = after, new
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member) with the same components as the given edges.

    At most one edge a vertex, however many pairs came in: tasks send on these, not the pairs.
    """
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    f = np.arange(len(ids))
    while True:
        fx, fy = f[x], f[y]
        hi, lo = np.maximum(fx, fy), np.minimum(fx, fy)
        open_ = hi != lo
        if not open_.any():
            break
        np.minimum.at(f, hi[open_], lo[open_])
        while True:
            g = f[f]
            if (g == f).all():
                break
            f = g
    child = np.nonzero(f != np.arange(len(ids)))[0]
    return ids[child], ids[f[child]]
