"""Pair generation, sampling and set operations on pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.scalars import ORPHAN, hash_order
from weft.session import durable


def canonical_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct unordered pairs (a, b), a < b."""
    x, y = F.col(a), F.col(b)
    return pairs.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


#: Records of one block of a cluster, about, pairs of one task, and the most tasks.
PAIR_BLOCK, TASK_PAIRS, MOST_TASKS = 1024, 2_000_000, 10_000
#: Records up to this many are at hand in every worker, which makes pairs of numbers by itself; beyond, numbers
#: or blocks meet records by joins.  The rows are the same.
AT_HAND = 1_000_000
#: Places of a task of random numbers, and pairs or places that are made at once.
PART, CHUNK = 1 << 22, 1 << 17


def gold_pairs(records: DataFrame, id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """Every pair of records of one cluster, once; records without a cluster or with an orphan's have none.
    The result is as large as the sum of the squares of the clusters: count with contingency tables where
    the pairs themselves aren't asked for.

    Up to AT_HAND records the workers hold the ids in the order of clusters and make pairs by arrays; beyond, and
    where an id is in several clusters, blocks of clusters meet by joins.  Either way the pairs are dealt out over
    as many tasks as their count asks for, and not shuffled unless an id is in several clusters."""
    r = records.where(F.col(cluster_col).isNotNull() & ~F.col(cluster_col).cast("string").startswith(ORPHAN) & F.col(id_col).isNotNull())
    r = durable(r.select(F.col(cluster_col).alias("c"), F.col(id_col).alias("id")).distinct())
    unique = r.groupBy("id").count().where("count > 1").isEmpty()
    if unique and r.count() <= AT_HAND:
        return _pairs_at_hand(r)
    both = _pairs_of_blocks(r)
    # Pairs come more than once only where both ids are in more than one cluster.
    return both if unique else both.where("a < b").distinct()


def _pairs_of_blocks(r: DataFrame) -> DataFrame:
    """The pairs of rows (c, id) of one c: a cluster is cut into blocks by hash, and two blocks meet as one row of
    two arrays."""
    sizes = r.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0
    blocks = r.join(sizes, "c").withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int"))
    blocks = blocks.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = durable(blocks.groupBy("c", "blocks", "i").agg(F.collect_list("id").alias("ids")))
    left = blocks.select("c", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"), F.col("ids").alias("xs"))
    met = left.join(blocks.select("c", F.col("i").alias("j"), F.col("ids").alias("ys")), ["c", "j"]).select("i", "j", "xs", "ys")
    met = met.repartition(max(1, min(MOST_TASKS, round(total / TASK_PAIRS))))
    both = met.select("i", "j", F.explode("xs").alias("x"), "ys").select("i", "j", "x", F.explode("ys").alias("y")).where("i < j or x < y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _pairs_at_hand(r: DataFrame) -> DataFrame:
    """The same by arrays: records stand by cluster and id, and one has the numbers from its start for its pairs with
    the later ones of its cluster.  A task makes the pairs of a stretch of numbers."""
    spark, kind = r.sparkSession, r.schema["id"].dataType.simpleString()
    sizes = r.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy("c").select("n").toArrow().column(0).to_numpy()
    later = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum()) - 1
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(later, dtype=np.int64)])
    total = int(starts[-1])
    step = max(TASK_PAIRS, -(-total // MOST_TASKS))
    ids = r.orderBy("c", "id").select("id").toArrow().column(0).combine_chunks()
    shared = spark.sparkContext.broadcast((ids, starts))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts = shared.value
        for first in (i for b in batches for i in b.column(0).to_pylist()):
            end = min(first + step, total)
            for at in range(first, end, CHUNK):
                to = min(at + CHUNK, end)
                k = np.arange(np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, to))
                x = np.repeat(k, np.minimum(starts[k + 1], to) - np.maximum(starts[k], at))
                y = x + 1 + np.arange(at, to) - starts[x]
                yield pa.record_batch([ids.take(pa.array(x)), ids.take(pa.array(y))], names=["a", "b"])

    return spark.range(0, total, step, max(1, -(-total // step))).mapInArrow(make, f"a {kind}, b {kind}")


def positive_pairs(records: DataFrame, id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """gold_pairs with label 1, for training."""
    return gold_pairs(records, id_col, cluster_col).select("a", "b", F.lit(1).alias("label"))


#: Pieces into which rows are cut by hash for running sums, and ranges into which index spaces are cut.
PIECES = 4096
#: Rounds of the index permutation.
ROUNDS = 4


def _piece(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 3), 16, 10).cast("int")


def cross_index(records: DataFrame, id_col: str = "id", cluster_col: str = "cluster") -> tuple[DataFrame, DataFrame, int]:
    """(rows (id, pos), clusters (c, s, n, lo), m): an index of all ``m`` unordered pairs of records of
    different clusters, without making one.

    Records stand in the order (piece of cluster, cluster, piece of id, id); cluster c has the ``n`` places
    from ``s``.  Its pairs with records before it have the ``n * s`` numbers from ``lo``: number lo + i is the
    pair of places s + i // s and i % s.  Places come from counts of pieces, so no task sorts more than one
    piece of one cluster, and no window without a partition holds more than PIECES rows.  Ids are unique;
    records without a cluster take no part.
    """
    r = records.where(F.col(cluster_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(cluster_col).alias("c"))
    r = durable(r.select("id", "c", _piece(F.col("c")).alias("cp"), _piece(F.col("id")).alias("ip")))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = r.groupBy("cp", "c", "ip").agg(F.count(F.lit(1)).alias("n"))
    clusters = pieces.groupBy("cp", "c").agg(F.sum("n").alias("n"))
    blocks = clusters.groupBy("cp").agg(F.sum("n").alias("n")).select("cp", before("n", Window.orderBy("cp")).alias("s0"))
    clusters = clusters.withColumn("s1", before("n", Window.partitionBy("cp").orderBy("c"))).join(F.broadcast(blocks), "cp")
    clusters = durable(clusters.select("cp", "c", "n", (F.col("s0") + F.col("s1")).alias("s")))
    starts = pieces.withColumn("s2", before("n", Window.partitionBy("c").orderBy("ip"))).join(clusters.select("c", "s"), "c")
    inside = F.row_number().over(Window.partitionBy("c", "ip").orderBy("id")) - 1
    rows = r.join(starts.select("c", "ip", (F.col("s") + F.col("s2")).alias("first")), ["c", "ip"]).select("id", (F.col("first") + inside).alias("pos"))
    weight = F.col("n") * F.col("s")
    blocks = clusters.groupBy("cp").agg(F.sum(weight).alias("w")).select("cp", before("w", Window.orderBy("cp")).alias("lo0"))
    spans = clusters.join(F.broadcast(blocks), "cp").withColumn("lo", F.col("lo0") + before(weight, Window.partitionBy("cp").orderBy("c")))
    m = clusters.agg(F.sum(weight).alias("m")).first()["m"] or 0
    return durable(rows), durable(spans.where(weight > 0).select("c", "s", "n", "lo")), m


def shuffled(t: Column, half: int, seed: str) -> Column:
    """The place of number ``t`` in a fixed random order of 0 .. 4 ** half - 1: a Feistel network whose round
    function is the first eight hex digits of md5(seed:round:right half)."""
    mask = (1 << half) - 1
    left, right = F.shiftright(t, half), t.bitwiseAND(F.lit(mask))
    for i in range(1, ROUNDS + 1):
        f = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{i}:"), right.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
        left, right = right, left.bitwiseXOR(f.bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, half).bitwiseOR(right)


def drawn(spark: SparkSession, m: int, size: int, seed: str) -> DataFrame:
    """(t, i): the first min(size, m) numbers i below ``m`` in a fixed random order, t being the place.  Places
    are tried in ascending order, about size * 4 at most; the cut is found from counts of ranges of places, of
    which only the one with the cut is sorted."""
    size = min(size, m)
    if size <= 0:
        return spark.createDataFrame([], "t bigint, i bigint")
    half = max(1, ((m - 1).bit_length() + 1) // 2)
    tries = min(1 << 2 * half, int(size * (1 << 2 * half) / m * 1.05) + 256)
    while True:
        found = spark.range(tries).select(F.col("id").alias("t"), shuffled(F.col("id"), half, seed).alias("i"))
        found = durable(found.where(F.col("i") < m))
        part = F.floor(F.col("t") * PIECES / tries).cast("int")
        counts = sorted((r["r"], r["n"]) for r in found.groupBy(part.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect())
        total = 0
        for r, n in counts:
            if total + n >= size:
                last = found.where(part == r).orderBy("t").limit(size - total)
                return found.where(part < r).unionByName(last)
            total += n
        tries = min(1 << 2 * half, tries * 2)


def round_tables(half: int, seed: str) -> np.ndarray:
    """The round function of ``shuffled`` for every right half: a row for each round."""
    first = lambda i: b"".join([md5(b"%s:%d:%d" % (seed.encode(), i, r)).digest()[:4] for r in range(1 << half)])
    return np.stack([np.frombuffer(first(i), ">u4").astype(np.uint32) & np.uint32((1 << half) - 1) for i in range(1, ROUNDS + 1)])


@dataclass(frozen=True)
class Numbers:
    """The numbers below ``m`` in the order of ``shuffled``, by arrays; cluster k has the numbers from lo[k], and
    number lo[k] + i is the pair of places s[k] + i // s[k] and i % s[k] (cross_index)."""

    m: int
    half: int
    tables: np.ndarray
    lo: np.ndarray
    s: np.ndarray

    def drawn(self, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places from ``start`` to ``stop`` that hold a number below m, with that number."""
        for at in range(start, stop, CHUNK):
            t = np.arange(at, min(at + CHUNK, stop), dtype=np.int64)
            left, right = (t >> self.half).astype(np.uint32), (t & ((1 << self.half) - 1)).astype(np.uint32)
            for f in self.tables:
                left, right = right, left ^ f[right]
            i = left.astype(np.int64) << self.half | right
            keep = np.flatnonzero(i < self.m)
            yield t[keep], i[keep]

    def pairs(self, start: int, stop: int, take: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(t, px, py): the first ``take`` of them with the places of their records."""
        for t, i in self.drawn(start, stop):
            if take <= 0:
                return
            t, i, take = t[:take], i[:take], take - len(t)
            k = np.searchsorted(self.lo, i, side="right") - 1
            s = self.s[k]
            x, y = np.divmod(i - self.lo[k], s)
            yield t, s + x, y


def numbers_at_hand(spans: DataFrame, m: int, seed: str) -> Numbers:
    half = max(1, ((m - 1).bit_length() + 1) // 2)
    held = spans.orderBy("lo").select("lo", "s").toArrow()
    return Numbers(m, half, round_tables(half, seed), *[held.column(c).to_numpy().astype(np.int64) for c in ("lo", "s")])


def cross_parts(spark: SparkSession, shared, size: int) -> DataFrame:
    """(start, stop, take): intervals of places, one a task, which hold the first ``size`` numbers of the
    broadcast Numbers; the cut is found from counts of intervals."""
    m, half = shared.value.m, shared.value.half
    size, schema = min(size, m), "start bigint, stop bigint, take bigint"
    if size <= 0:
        return spark.createDataFrame([], schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([sum(len(t) for t, _ in shared.value.drawn(a, min(a + step, tries))) for a in at], pa.int64())], names=["start", "n"])

    tries = min(1 << 2 * half, int(size * (1 << 2 * half) / m * 1.05) + 256)
    while True:
        step = max(PART, -(-tries // PIECES))
        counts = dict(spark.range(0, tries, step, -(-tries // step)).mapInArrow(count, "start bigint, n bigint").collect())
        if sum(counts.values()) >= size:
            break
        tries = min(1 << 2 * half, tries * 2)
    parts = []
    for start, n in sorted(counts.items()):
        if size > 0:
            parts.append((start, min(start + step, tries), min(n, size)))
        size -= n
    return spark.createDataFrame(parts, schema).repartition(len(parts))


def cross_sample(records: DataFrame, size: int, seed: str, id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """(a, b, t): ``size`` pairs of records of different clusters, a < b, uniform without replacement, the same
    in every run; all of them if there are fewer.  ``t`` is the place in the random order.

    One rule at every size: numbers of pairs are drawn and turned into pairs, so the work is in proportion to
    the records and ``size``, not to the pairs there are.  Up to AT_HAND records the workers do so by arrays, and
    nothing but the pairs leaves them; beyond, intervals of clusters meet numbers by an equi-join on ranges of
    numbers, and places meet records."""
    rows, spans, m = cross_index(records, id_col, cluster_col)
    spark = records.sparkSession
    if rows.count() <= AT_HAND:
        return _sample_at_hand(rows, spans, m, size, seed)
    numbers = drawn(spark, m, size, seed)
    ranges = lambda i: F.floor(i.cast("double") * (PIECES / max(m, 1)))
    last = F.col("lo") + F.col("n") * F.col("s") - 1
    # A range more on both sides, for what rounding moves over an edge.
    spread = spans.select("s", "lo", last.alias("hi"), F.explode(F.sequence(ranges(F.col("lo")) - 1, ranges(last) + 1)).alias("r"))
    met = numbers.withColumn("r", ranges(F.col("i"))).join(spread, "r").where("i >= lo and i <= hi").withColumn("i", F.col("i") - F.col("lo"))
    places = met.select("t", (F.col("s") + F.expr("i div s")).alias("px"), (F.col("i") % F.col("s")).alias("py"))
    both = places.join(rows.toDF("x", "px"), "px").join(rows.toDF("y", "py"), "py")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "t")


def _sample_at_hand(rows: DataFrame, spans: DataFrame, m: int, size: int, seed: str) -> DataFrame:
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    held = rows.orderBy("pos").select("id").toArrow().column(0).combine_chunks()
    shared, ids = spark.sparkContext.broadcast(numbers_at_hand(spans, m, seed)), spark.sparkContext.broadcast(held)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, take in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for t, px, py in shared.value.pairs(start, stop, take):
                    x, y = ids.value.take(pa.array(px)), ids.value.take(pa.array(py))
                    yield pa.record_batch([pc.min_element_wise(x, y), pc.max_element_wise(x, y), pa.array(t)], names=["a", "b", "t"])

    return cross_parts(spark, shared, size).mapInArrow(make, f"a {kind}, b {kind}, t bigint")


def negative_sample(records: DataFrame, size: int, seed: str = "neg", id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """cross_sample with label 0, for training."""
    return cross_sample(records, size, seed, id_col, cluster_col).select("a", "b", F.lit(0).alias("label"))


def record_sample(records: DataFrame, size: int = 2000, seed: str = "rec", id_col: str = "id") -> DataFrame:
    """``size`` rows, uniform without replacement, the same in every run; all if there are fewer."""
    return records.orderBy(hash_order(seed, F.col(id_col)), id_col).limit(size)


def nonmatch_sample(records: DataFrame, known: DataFrame, size: int, seed: str = "non", id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """``size`` random pairs of different clusters that aren't among ``known`` (a, b): the first of a random
    order that is long enough to lose all known ones."""
    known = durable(canonical_pairs(known))
    pool = cross_sample(records, size + known.count(), seed, id_col, cluster_col)
    return pool.join(known, ["a", "b"], "left_anti").orderBy("t").limit(size).select("a", "b")


def trainable(pairs: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Pairs (a, b, …) of which both records have a vector."""
    ids = vectors.select(F.col(id_col).alias("a")).distinct()
    return pairs.join(ids, "a", "left_semi").join(ids.toDF("b"), "b", "left_semi")
