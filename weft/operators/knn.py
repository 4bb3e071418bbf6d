"""Exact nearest neighbours by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import durable

#: Vectors up to this many bytes go to every worker; more meet in pairs of blocks.
BROADCAST_BYTES = 64 << 20
#: Rows of a block where they don't.
BLOCK_ROWS = 8192


def nearest(qi: np.ndarray, q: np.ndarray, qg, xi: np.ndarray, x: np.ndarray, xg, k: int, step: int = 512) -> Iterator[tuple]:
    """(src, dst array, d2 array) of each query's k nearest rows but itself, by (distance, id); with groups,
    rows of the query's own group are left out.  Distances of the final choice are sums of squared
    differences, so equal vectors tie exactly."""
    norms = (x * x).sum(axis=1)
    for a in range(0, len(q), step):
        part = q[a : a + step]
        rough = norms - 2.0 * (part @ x.T) + (part * part).sum(axis=1)[:, None]
        rough[qi[a : a + step, None] == xi] = np.inf
        if qg is not None:
            rough[qg[a : a + step, None] == xg] = np.inf
        kk = min(k, len(x))
        kth = np.partition(rough, kk - 1, axis=1)[:, kk - 1]
        for i in range(len(part)):
            near = np.flatnonzero((rough[i] <= kth[i] + 1e-9 * (1 + abs(kth[i]))) & np.isfinite(rough[i])) if np.isfinite(kth[i]) else np.flatnonzero(np.isfinite(rough[i]))
            diff = x[near] - part[i]
            d2 = np.einsum("ij,ij->i", diff, diff)
            order = np.lexsort((xi[near], d2))[:k]
            yield qi[a + i], xi[near[order]], d2[order]


def _columns(b: pa.RecordBatch, dim: int):
    flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    groups = b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else None
    return b.column(0).to_numpy(zero_copy_only=False), flat.reshape(-1, dim), groups


def _edges(found, kind) -> Iterator[pa.RecordBatch]:
    src, dst, d2 = [], [], []
    for s, d, v in found:
        src.append(np.repeat(s, len(d)))
        dst.append(d)
        d2.append(v)
    if src:
        yield pa.record_batch([pa.array(np.concatenate(src), kind), pa.array(np.concatenate(dst), kind), pa.array(np.concatenate(d2))], names=["src", "dst", "d2"])


def _kind(df: DataFrame):
    kind = df.schema["id"].dataType.simpleString()
    return kind, pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()


def pack_blocks(rows: DataFrame, dim: int, keys: list[str]) -> DataFrame:
    """(*keys, data): the rows (id, v[, g]) of each key as one cell, ids and a matrix."""
    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}
    inner = [c for c in rows.columns if c not in keys]

    def pack(table: pa.Table) -> pa.Table:
        b = table.combine_chunks().to_batches()[0]
        ids, x, g = _columns(b.select(inner), dim)
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([pa.array(ids), pa.array([x.tobytes()] + [None] * (len(ids) - 1), pa.binary()), *([pa.array(g)] if g is not None else [])], names=["id", "x", "g"][: 2 + (g is not None)])
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        cells = [table.column(k).slice(0, 1).combine_chunks() for k in keys]
        return pa.table([*cells, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*keys, "data"])

    return rows.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", data binary")


def unpack(data: bytes, dim: int):
    """(ids, matrix, groups or None) of a cell of pack_blocks."""
    b = pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]
    return b.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b.column(1)[0].as_buffer(), np.float64).reshape(-1, dim), b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else None


def knn(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", group_col: str | None = None, broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, rank, d2): the k nearest other rows of every row, nearest first, ties by id.

    ``k`` of n or more means n - 1; no rows or no k, an empty graph.  Rows without a vector take no part.
    With ``group_col`` neighbours come from other groups only.  Vectors within ``broadcast_bytes`` (counted
    first) are broadcast; beyond, blocks of ``block_rows`` rows are packed into matrices, each block meets
    each other block once as a task of matrix products, and the k best of each meeting are merged.
    """
    cols = [F.col(id_col).alias("id"), F.col(vec_col).alias("v"), *([F.col(group_col).alias("g")] if group_col else [])]
    rows = vectors.where(F.col(vec_col).isNotNull()).select(*cols)
    spark, (kind, arrow) = vectors.sparkSession, _kind(rows)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    k = min(k, n - 1)
    schema = f"src {kind}, dst {kind}, d2 double"
    if n == 0 or k <= 0:
        return spark.createDataFrame([], schema).selectExpr("src", "dst", "cast(0 as int) as rank", "d2")
    if n * dim * 8 <= broadcast_bytes:
        local = rows.toArrow().combine_chunks()
        batch = local.to_batches()[0]
        shared = spark.sparkContext.broadcast(_columns(batch, dim))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            xi, x, xg = shared.value
            for b in batches:
                if b.num_rows:
                    qi, q, qg = _columns(b, dim)
                    yield from _edges(nearest(qi, q, qg, xi, x, xg, k), arrow)

        parts = min(spark.sparkContext.defaultParallelism, max(1, n // 1024))
        spread = rows.repartition(parts, "id") if parts > 1 else rows.coalesce(1)
        best = spread.mapInArrow(search, schema)
    else:
        blocks = -(-n // block_rows)
        packed = pack_blocks(rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), *rows.columns), dim, ["block"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for qd, xd in zip(b.column(0), b.column(1), strict=True):
                    qi, q, qg = unpack(qd.as_py(), dim)
                    xi, x, xg = unpack(xd.as_py(), dim)
                    yield from _edges(nearest(qi, q, qg, xi, x, xg, k), arrow)

        asked = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("data").alias("q"))
        best = asked.join(packed, "block").select("q", "data").repartition(min(blocks * blocks, 10_000)).mapInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "rank", "d2")


def within(vectors: DataFrame, radius: float, id_col: str = "id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b), a < b: all pairs at most ``radius`` apart.  Blocks meet in pairs, each pair of blocks once, as
    matrix products; only pairs within the radius leave a task.  Rows without a vector take no part."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    kind, arrow = _kind(rows)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    if n < 2:
        return vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    blocks = -(-n // block_rows)
    packed = durable(pack_blocks(rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v"), dim, ["block"]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, qd, xd in zip(*batch.columns, strict=True):
                qi, q, _ = unpack(qd.as_py(), dim)
                xi, x, _ = unpack(xd.as_py(), dim)
                norms = (x * x).sum(axis=1)
                for k in range(0, len(q), 512):
                    part = q[k : k + 512]
                    rough = norms - 2.0 * (part @ x.T) + (part * part).sum(axis=1)[:, None]
                    r, c = np.nonzero(rough <= radius * radius + 1e-9 * (1 + radius * radius))
                    diff = part[r] - x[c]
                    near = np.sqrt(np.einsum("ij,ij->i", diff, diff)) <= radius
                    a, b = qi[k + r[near]], xi[c[near]]
                    keep = a < b if i.as_py() == j.as_py() else np.ones(len(a), bool)
                    a, b = a[keep], b[keep]
                    low = a < b
                    yield pa.record_batch([pa.array(np.where(low, a, b), arrow), pa.array(np.where(low, b, a), arrow)], names=["a", "b"])

    left = packed.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"), F.col("data").alias("q"))
    met = left.join(packed.toDF("j", "x"), "j").select("i", "j", "q", "x").repartition(min(blocks * (blocks + 1) // 2, 10_000))
    return met.mapInArrow(meet, f"a {kind}, b {kind}")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, d2) with a < b, each pair once."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "d2").groupBy("a", "b").agg(F.min("d2").alias("d2"))
