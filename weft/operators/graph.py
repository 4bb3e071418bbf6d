"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import durable


def canonical_edges(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct undirected edges (a, b) with a < b; self-loops and null ends are dropped."""
    x, y = F.col(a), F.col(b)
    return edges.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _ranked(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, a: str = "src", b: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(id, component): the component is the smallest id reachable; isolated ``vertices`` (a table with
    column ``id``) are their own.

    Contraction: in each round every node joins the neighbour of least random rank, edges move to the
    chosen nodes, and edges inside a group vanish.  A constant share of the nodes goes in each round
    whatever the graph's shape, and nothing reaches the driver but "are any edges left".
    """
    left = durable(canonical_edges(edges, a, b))
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
        best = both.groupBy("u").agg(F.min(_ranked("v")).alias("best"))
        step = durable(best.select(F.col("u").alias("node"), F.when(F.col("best") < _ranked("u"), F.col("best.id")).otherwise(F.col("u")).alias("parent")))
        steps.append(step)
        pa, pb = step.toDF("a", "pa"), step.toDF("b", "pb")
        left = durable(canonical_edges(left.join(pa, "a").join(pb, "b"), "pa", "pb"))
    else:
        raise RuntimeError(f"connected_components: edges left after {max_rounds} rounds")
    if steps:
        roots = steps[0].toDF("id", "root")
        for step in steps[1:]:
            roots = roots.join(step.toDF("root", "next"), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        roots = durable(roots) if len(steps) > 1 else roots
        least = roots.groupBy("root").agg(F.min("id").alias("component"))
        found = roots.join(least, "root").select("id", "component")
    else:
        found = canonical_edges(edges, a, b).select(F.col("a").alias("id"), F.col("a").alias("component"))
    if vertices is None:
        return found
    return vertices.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clusters_of(vertices: DataFrame, positive: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Predicted clusters: components of the positive pairs over all evaluated ids."""
    return connected_components(positive, vertices, a, b)


def _cycles(edges: DataFrame) -> DataFrame:
    """(f, x, y, p_fx, p_fy, p_xy) with x < y: each triangle of scored edges (a, b, p), a < b, once, from its
    vertex of least (degree, id).  Edges point from lower to higher degree, so no vertex has more than about
    sqrt(2 * edges) of them going out, and a hub makes no more paths of two than other vertices."""
    degree = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    both = edges.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    out = durable(both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("f"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"), "p"))
    paths = out.toDF("f", "x", "p_fx").join(out.toDF("f", "y", "p_fy"), "f").where("x < y")
    return paths.join(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("p").alias("p_xy")), ["x", "y"])


def common_neighbors(edges: DataFrame) -> DataFrame:
    """(a, b, common): for each undirected edge (a, b), a < b, how many vertices are next to both: the triangles
    it is in."""
    found = _cycles(edges.select("a", "b", F.lit(1).alias("p")))
    sides = F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("f", "x"), ("f", "y"), ("x", "y"))])
    count = found.select(F.explode(sides).alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("common"))
    return edges.select("a", "b").join(count, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).cast("long").alias("common"))


def triangles(scored: DataFrame) -> DataFrame:
    """(u, v, w, p_uv, p_vw, p_wu) with u < v < w for scored edges (a, b, score), a < b: each triangle once."""
    t = _cycles(scored.select("a", "b", F.col("score").alias("p")))
    first, last = F.col("f") < F.col("x"), F.col("f") > F.col("y")
    pick = lambda low, middle, high: F.when(first, F.col(low)).when(last, F.col(high)).otherwise(F.col(middle))
    return t.select(
        pick("f", "x", "x").alias("u"), pick("x", "f", "y").alias("v"), pick("y", "y", "f").alias("w"),
        pick("p_fx", "p_fx", "p_xy").alias("p_uv"), pick("p_xy", "p_fy", "p_fy").alias("p_vw"), pick("p_fy", "p_xy", "p_fx").alias("p_wu"),
    )
