"""Blocking scenarios over the k-NN graph: merge the closest clusters, or bridge all close ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.scalars import squared_distance
from weft.operators.graph import connected_components
from weft.operators.knn import BLOCK_ROWS, _kind, knn, nearest, pack_blocks, unpack, within
from weft.session import durable


def centroids(members: DataFrame, cluster_col: str = "component", vec_col: str = "embedding") -> DataFrame:
    """(component, centroid): element-wise means; clusters without vectors have no row.  Sums are made before
    the shuffle, a row for each cluster and dimension."""
    long = members.select(F.col(cluster_col).alias("component"), F.posexplode(vec_col).alias("pos", "x"))
    mean = long.groupBy("component", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def closest_clusters(members: DataFrame, metric: str = "centroid") -> DataFrame:
    """At most one row (a, b, d2): the closest two clusters, a < b, by centroid or by their nearest records;
    ties by (a, b).  Fewer than two clusters: none."""
    if metric == "centroid":
        near = knn(centroids(members), 1, "component", "centroid").select("src", "dst", "d2")
    elif metric == "shortest":
        c = members.select("id", "component")
        near = knn(members, 1, "id", "embedding", "component").select("src", "dst", "d2")
        near = near.join(c.toDF("src", "ca"), "src").join(c.toDF("dst", "cb"), "dst").select(F.col("ca").alias("src"), F.col("cb").alias("dst"), "d2")
    else:
        raise ValueError(f"unknown metric {metric!r}")
    best = near.agg(F.min(F.struct("d2", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))).alias("x"))
    return best.where("x is not null").select("x.a", "x.b", "x.d2")


def merge_closest(members: DataFrame, metric: str = "centroid") -> DataFrame:
    """(id, component) with the closest two clusters as one."""
    pair = closest_clusters(members, metric)
    c = members.select("id", "component")
    return c.join(F.broadcast(pair.select("a", F.col("b").alias("component"))), "component", "left").select("id", F.coalesce("a", "component").alias("component"))


def close_clusters(members: DataFrame, threshold: float) -> DataFrame:
    """(ca, cb): clusters, ca < cb, with centroids at most ``threshold`` apart, by matrix products of blocks of
    centroids."""
    return within(durable(centroids(members)), threshold, "component", "centroid").toDF("ca", "cb")


def nearest_pairs(members: DataFrame, close: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(ca, cb, a, b, d2): for each pair of clusters in ``close`` (ca, cb) its nearest records, ties by (d2, a, b).

    Clusters are cut into blocks of about ``block_rows`` rows; the blocks of two close clusters meet in pairs as
    matrix products, and a meeting gives one row."""
    rows = members.where("embedding is not null").select("id", "component", F.col("embedding").alias("v"))
    kind, arrow = _kind(rows)
    cluster = members.schema["component"].dataType.simpleString()
    empty = f"ca {cluster}, cb {cluster}, a {kind}, b {kind}, d2 double"
    dim = rows.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if dim is None:
        return members.sparkSession.createDataFrame([], empty)
    wanted = close.select(F.col("ca").alias("component")).union(close.select("cb")).distinct()
    sizes = rows.join(wanted, "component").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    cut = rows.join(sizes, "component").select("component", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
    packed = durable(pack_blocks(cut, dim, ["component", "block"])).drop("block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                qi, q, _ = unpack(batch.column(2)[k].as_py(), dim)
                xi, x, _ = unpack(batch.column(3)[k].as_py(), dim)
                d2, a, b = min((float(d[0]), s, t[0]) for s, t, d in nearest(qi, q, None, xi, x, None, 1))
                yield pa.record_batch([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([a], arrow), pa.array([b], arrow), pa.array([d2])], names=["ca", "cb", "a", "b", "d2"])

    met = close.join(packed.toDF("ca", "q"), "ca").join(packed.toDF("cb", "x"), "cb").select("ca", "cb", "q", "x")
    best = met.mapInArrow(meet, empty).groupBy("ca", "cb").agg(F.min(F.struct("d2", "a", "b")).alias("m"))
    return best.select("ca", "cb", "m.a", "m.b", "m.d2")


def bridges(members: DataFrame, threshold: float = 0.5, n: int = 2) -> DataFrame:
    """(a, b): new edges between close clusters.  For clusters ca < cb the nearest records (a*, b*) are
    found, and the ``n`` records of ca nearest to b* are linked to it; ties by id.  Only b* meets all of ca."""
    close = durable(close_clusters(members, threshold))
    m = members.select("id", "component", "embedding")
    star = nearest_pairs(members, close).select("ca", "cb", "b").join(m.select(F.col("id").alias("b"), F.col("embedding").alias("vb")), "b")
    near = star.join(m.toDF("a", "ca", "va"), "ca").select("ca", "cb", "a", "b", squared_distance(F.col("va"), F.col("vb")).alias("d2"))
    rank = F.row_number().over(Window.partitionBy("ca", "cb").orderBy("d2", "a"))
    return near.withColumn("r", rank).where(F.col("r") <= n).select("a", "b").distinct()


def bridged(members: DataFrame, edges: DataFrame, threshold: float = 0.5, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """(edges, components) after bridging; fewer than two components leave the graph as it is."""
    new = bridges(members, threshold, n).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    all_edges = durable(edges.select("a", "b").unionByName(new).distinct())
    return all_edges, connected_components(all_edges, members.select("id"), "a", "b")
