"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import durable

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], budget_ratio: float, max_repeats: int) -> DataFrame:
    """One row per source with its weight and target.

    ``totals`` has (skey, source, source_size).  Weights repeat over the sources in code-point order,
    null last.  The budget is shared by weight; a source gets ``max_repeats`` times its size at most and
    what is above goes to the others by weight, until none is above (water filling: with sources in the
    order of their cap per weight, the level is the budget that earlier caps leave, over the weights
    from here on; a source is at its cap if its cap per weight is not above that level).

    The windows here have no partition: they hold one row per source, not per document.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("rank", rank).withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    t = t.withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget_ratio)))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("budget") - before) / rest)
    t = t.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    t = t.withColumn("water", F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy()))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("water"))
    return t.select("skey", "source", "source_size", "weight", target.alias("target"), "budget")


def fair_queue(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    budget_ratio: float = 1.5,
    max_repeats: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    buckets: int = 4096,
) -> DataFrame:
    """Every document with its place in its source's queue: (doc_id, source, size, source_size, weight,
    target, budget, skey, served), ``served`` being the source's words up to and including this document.

    A source's queue is in the order of md5(seed:doc_id).  Its running total does not run through one
    task: the hash's first digits cut each source into ``buckets`` pieces, whose totals (at most
    ``buckets`` rows a source) give each piece its start; the running sum is inside a piece.
    """
    if buckets != 4096:
        raise ValueError("buckets are the first three hex digits of the hash: 4096")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~")).alias("skey"),
            word_count(F.col(text_col)).alias("size"),
            order.alias("ord"),
        )
    )
    bucket = F.conv(F.substring("ord", 1, 3), 16, 10).cast("int").alias("bucket")
    pieces = sized.groupBy("skey", "source", bucket).agg(F.sum("size").alias("piece"))
    run = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum("piece").over(run), F.lit(0)))
    targets = source_targets(sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights, budget_ratio, max_repeats)
    starts = pieces.select("skey", "bucket", "start").join(targets.drop("source"), "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    served = F.col("start") + F.sum("size").over(inside)
    return sized.withColumn("bucket", bucket).join(starts, ["skey", "bucket"]).withColumn("served", served).drop("bucket", "ord", "start")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget_ratio: float = 1.5, max_repeats: int = 2, ranges: int = 65536, **queue) -> DataFrame:
    """The mix: per document (doc_id, source, size, source_size, weight, target, finish_time, copies, taken).

    Weighted fair queueing: a copy of a document finishes at the virtual time "words of its source up to
    and including it / weight"; the k-th pass over a source follows the one before.  All copies are put in
    the order of (finish time, source) and taken while their sum is within the budget of ``budget_ratio``
    times all words.  The global order is by ranges of virtual time: a histogram of words over ``ranges``
    equal ranges (``ranges`` rows, whatever the input) shows the range where the budget ends; only the
    copies of that range are sorted together, to find the last copy taken.  A document counts whole or not
    at all, so a source misses its target by less than one of its documents, and where the budget ends
    inside documents of several sources, by about one document each.

    Null text or no word: size 0, taken 0.  Null source: a source of its own, last.  The order depends on
    ``seed`` and doc_id only, so reruns agree; rows of equal doc_id and size are interchangeable.
    Empty input: empty output.  Other columns of ``docs`` are ignored.
    """
    q = durable(fair_queue(docs, weights, budget_ratio, max_repeats, **queue))
    top = q.agg(F.max(F.col("source_size") * max_repeats / F.col("weight")).alias("t"), F.max("budget").alias("b")).first()
    last, budget = float(top["t"] or 0.0) or 1.0, float(top["b"] or 0.0)

    def finish(k: int) -> Column:
        return (F.col("served") + F.col("source_size") * k) / F.col("weight")

    def range_of(t: Column) -> Column:
        return F.least(F.floor(t * (ranges / last)), F.lit(ranges - 1)).cast("int")

    copies = q.where("size > 0").select("skey", "size", F.explode(F.array(*[finish(k) for k in range(max_repeats)])).alias("t")).withColumn("r", range_of(F.col("t")))
    running = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    hist = copies.groupBy("r").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(running))
    over = hist.where(F.col("upto") > budget).agg(F.min(F.struct("r", (F.col("upto") - F.col("n")).alias("before"))).alias("x")).first()["x"]
    if over is None:
        takes = [F.lit(True)] * max_repeats
    else:
        in_range = Window.orderBy("t", "skey").rowsBetween(Window.unboundedPreceding, 0)
        cut = copies.where(F.col("r") == over["r"]).withColumn("upto", F.sum("size").over(in_range) + over["before"])
        cut = cut.where(F.col("upto") <= budget).agg(F.max(F.struct("t", "skey")).alias("x")).first()["x"]
        t_cut, s_cut = (cut["t"], cut["skey"]) if cut is not None else (-1.0, "")

        def taken(k: int) -> Column:
            t, r = finish(k), range_of(finish(k))
            return (r < over["r"]) | ((r == over["r"]) & ((t < t_cut) | ((t == t_cut) & (F.col("skey") <= s_cut))))

        takes = [taken(k) for k in range(max_repeats)]
    n = sum((F.when(x, 1).otherwise(0) for x in takes[1:]), F.when(takes[0], 1).otherwise(0))
    n = F.when(F.col("size") > 0, n).otherwise(0)
    return q.select("doc_id", "source", "size", "source_size", "weight", "target", finish(0).alias("finish_time"), n.alias("copies"), (n * F.col("size")).cast("long").alias("taken"))
