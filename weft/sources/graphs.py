"""Graph files: adjacency and node-link JSON in, adjacency, pairs and cluster listings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.pairs import canonical_pairs
from weft.session import numbered
from weft.sources.files import documents, json_text, write_documents


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each JSON file of a path as one row with a column doc; null if it doesn't fit the schema, no row if there
    is no file."""
    return documents(spark, path).select(F.from_json("value", schema).alias("doc"))


def read_adjacency(spark: SparkSession, path: str, self_loops: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices (id), edges (src, dst, rank)) of {id: [neighbour, …]}; vertices without neighbours stay."""
    rows = _document(spark, path, "map<string,array<string>>").select(F.explode("doc").alias("src", "near"))
    edges = rows.select("src", F.posexplode("near").alias("pos", "dst")).select("src", "dst", (F.col("pos") + 1).alias("rank"))
    if not self_loops:
        edges = edges.where("src <> dst")
    return rows.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def read_node_link(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of {nodes, links: [{source, target}]}; loops and empty or "None" ends are dropped."""
    doc = _document(spark, path, "struct<links:array<struct<source:string,target:string>>>")
    rows = doc.select(F.explode("doc.links").alias("l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"))
    ok = [F.coalesce(F.col(c), F.lit("")).isin("", "None") for c in ("src", "dst")]
    return rows.where(~ok[0] & ~ok[1] & (F.col("src") != F.col("dst")))


def read_pairs_of_graph(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pairs (a, b) of either kind of graph file; none where it is missing or of neither."""
    text = documents(spark, path)
    links = text.select(F.explode(F.from_json("value", "struct<links:array<struct<source:string,target:string>>>")["links"]).alias("l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"))
    near = text.where(F.get_json_object("value", "$.links").isNull()).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("src", "n")).select("src", F.explode("n").alias("dst"))
    return canonical_pairs(links.unionByName(near).where("src is not null and dst is not null and src not in ('', 'None') and dst not in ('', 'None')"), "src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbors) nearest first, of directed ranked edges."""
    near = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda s: s["dst"])
    return edges.groupBy("src").agg(near.alias("neighbors"))


def symmetric_adjacency(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, neighbors) of undirected edges (a, b), both ways; isolated vertices have an empty list."""
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    near = both.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))
    return vertices.select(F.col("id").alias("src")).join(near, "src", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast(near.schema["neighbors"].dataType)))


def write_adjacency(adj: DataFrame, path: str, files: int | None = None) -> None:
    """JSON maps {id: [neighbour, …]}, a whole document in each file: many writers, no driver."""
    element = F.concat(json_text(F.col("src")), F.lit(": "), F.to_json(F.col("neighbors").cast("array<string>")))
    write_documents(adj.select(element.alias("value")), path, "{}", files)


def cluster_listing(components: DataFrame, prefix: str = "knn_cluster_", details: DataFrame | None = None, first: int = 0, node: bool = False) -> DataFrame:
    """(name, component, ids) with clusters numbered from ``first`` by their smallest id, and with ``node`` that
    id in the name; with ``details`` (id, details) also the members' texts, of which a missing one says so.  Only
    the clusters' ids are numbered, by ranges; members are joined afterwards."""
    number = (F.col("number") + first).cast("string")
    name = F.concat(F.lit(prefix), number, *([F.lit("_node_"), F.col("component").cast("string")] if node else []))
    names = numbered(components.select("component").distinct(), "component").select("component", name.alias("name"))
    rows = components
    cols = [F.array_sort(F.collect_list("id")).alias("ids")]
    if details is not None:
        rows = components.join(details, "id", "left").withColumn("details", F.coalesce("details", F.concat(F.lit("Details not found for "), F.col("id").cast("string"))))
        cols.append(F.array_sort(F.collect_list(F.struct(F.col("id").alias("record_id"), "details"))).alias("members"))
    g = rows.groupBy("component").agg(*cols)
    return g.join(names, "component").select("name", "component", *[c for c in g.columns if c != "component"])


def write_clusters(listing: DataFrame, path: str, files: int | None = None) -> None:
    """JSON maps {name: [{record_id, details}, …]} of a listing with members."""
    members = F.transform("members", lambda m: F.struct(m["record_id"].cast("string").alias("record_id"), m["details"].alias("details")))
    write_documents(listing.select(F.concat(json_text(F.col("name")), F.lit(": "), F.to_json(members)).alias("value")), path, "{}", files)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(name, record_id, details) of such files; nothing where they are missing or broken."""
    doc = _document(spark, path, "map<string,array<struct<record_id:string,details:string>>>")
    return doc.select(F.explode("doc").alias("name", "members")).select("name", F.inline("members"))
