"""Token counts: an exact histogram of encoded lengths, and what suffix sums over it answer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.bpe import codec, default_path
from weft.session import durable, slices

#: Lengths of one block of the sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every whole text; 0 for a null or empty one.  Rows keep their number, repeated ones too;
    an empty table gives none; other columns are ignored."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            yield pa.record_batch([b.column(0), pa.array([len(c.encode(t.as_py())) for t in b.column(1)], pa.int64())], names=[id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs, n_tokens, docs_upto, docs_from, tokens_from, truncated_total, lost_tokens), a row for
    each length that occurs.

    docs_upto counts documents of this length or less, docs_from and tokens_from those of this length or
    more; truncated_total is what is left of all tokens if every document is cut to this length, lost_tokens
    the rest.  Sums run inside blocks of BLOCK lengths and over the blocks' totals, so no task holds more than
    BLOCK rows or one row a block.  Null lengths count as 0; an empty table has no rows.  The counts, a row for
    each length, are written before they are used twice, so texts are encoded once.
    """
    hist = lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = durable(hist).withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select(
        "block",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"],
        *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in "dt"],
    )
    upto = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.join(blocks, "block")
    h = h.withColumn("docs_upto", F.col("d_before") + F.sum("n_docs").over(upto)).withColumn("tokens_upto", F.col("t_before") + F.sum("n_tokens").over(upto))
    above = F.col("d_all") - F.col("docs_upto")
    cut = F.col("tokens_upto") + above * F.col("length")
    return h.select(
        "length", "n_docs", "n_tokens", "docs_upto", (above + F.col("n_docs")).alias("docs_from"), (F.col("t_all") - F.col("tokens_upto") + F.col("n_tokens")).alias("tokens_from"),
        cut.alias("truncated_total"), (F.col("t_all") - cut).alias("lost_tokens"),
    )


def truncated_totals(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, total): all tokens if every document is cut to ``limit``, for limits that need not occur:
    tokens of shorter documents, and the limit for each document of at least that length."""
    out = [F.sum(F.least(F.col("length"), F.lit(n)) * F.col("n_docs")).alias(str(n)) for n in limits]
    row = hist.agg(*out)
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("limit"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("total")) for n in limits])).alias("x")).select("x.*")


def quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length that at least ``share`` of the documents don't exceed."""
    total = hist.agg(F.max("docs_upto").alias("n")).first()["n"] or 0
    least = [F.min(F.when(F.col("docs_upto") >= F.greatest(F.ceil(F.lit(float(s)) * total), F.lit(1)), F.col("length"))) for s in shares]
    row = hist.agg(F.array(*least).alias("lengths"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("lengths").alias("length"))
    return row.select(F.explode(pairs).alias("x")).select(F.col("x.share").alias("share"), F.col("x.length").alias("length"))
