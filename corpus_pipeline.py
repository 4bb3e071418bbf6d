"""The corpus pipeline: rules, near-duplicates, secrets, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bpe import default_path, encode_documents
from weft.llm.minhash import near_duplicates
from weft.llm.mixing import mix_sources
from weft.llm.quality import keep_good, train_line_crf
from weft.llm.secrets import redact_documents
from weft.session import broadcast_if_few, durable, shared_folder, table

#: Least similarity, in percent, of near-duplicates; only op10_neardup's contract asks for 85.
NEAR = 80

#: The columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the labels of the data folder train the line model.  Null and
    empty texts go, as all of fewer than 50 words; rows are judged one by one, so repeated ones stay or go
    together; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    return keep_good(docs, train_line_crf(docs, table(spark, sf_dir, "labels")))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _key, a hash of the whole row: only equal rows share one, whatever their doc_id."""
    columns = [F.col(c) for c in COLUMNS]
    return docs.select(*columns, F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("_key"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id, null being the largest; of equal
    doc_ids, that of the smallest hash of the row.  Rows without words are in no group and stay."""
    docs = keyed(docs)
    found = near_duplicates(docs, NEAR, id_col="_key").where("n_shingles > 0").select(F.col("doc_id").alias("_key"), "component_id")
    found = durable(found)
    large = found.groupBy("component_id").count().where("count > 1").select("component_id")
    rows = found.join(large, "component_id").groupBy("_key", "component_id").agg(F.count(F.lit(1)).alias("_rows"))
    rows = broadcast_if_few(rows)
    ids = docs.select("_key", "doc_id").join(rows, "_key")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key")))["_key"].alias("_first")
    marks = rows.join(ids.groupBy("component_id").agg(first), "component_id").select("_key", "_rows", (F.col("_key") == F.col("_first")).alias("_stays"))
    marked = docs.join(broadcast_if_few(marks), "_key", "left").where("_stays is null or _stays")
    equal = marked.where("_rows > 1").dropDuplicates(["_key"])
    return marked.where("_rows is null or _rows = 1").unionByName(equal).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by its kind; all rows stay, null texts stay null."""
    return redact_documents(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice.  Equal rows, which can't be told from
    each other, come as often as the mix takes all of them together.  Rows without a word are never taken; null
    sources are one source; an empty table stays empty."""
    docs = keyed(docs)
    copies = mix_sources(docs, id_col="_key").groupBy(F.col("doc_id").alias("_key")).agg(F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = docs.join(broadcast_if_few(copies.where("_copies > 0")), "_key")
    taken = taken.where("_rows = 1").unionByName(taken.where("_rows > 1").dropDuplicates(["_key"]))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training tokens: (doc_id, n_tokens, ids), a row for each copy in the mix; null and empty texts, which
    earlier stages drop, would have none; an empty table stays empty."""
    coded = encode_documents(docs, default_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("bpe", bpe)]

#: The line model of the first stage has no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.  The folder is
    deleted when the driver ends."""
    folder = shared_folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
