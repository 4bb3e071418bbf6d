"""Incremental judging: candidate pairs arrive as a stream, each is judged once and cached."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.judging import judge_pairs
from weft.session import durable
from weft.sources.files import append_cache

CACHE_SCHEMA = "key string, is_similar boolean, score double"


def read_cache_table(spark, path: str) -> DataFrame:
    """The cache folder; empty before the first batch."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(CACHE_SCHEMA).parquet(path) if exists else spark.createDataFrame([], CACHE_SCHEMA)


def judge_stream(pairs: DataFrame, judge: Callable[[str], str], cache_path: str, out_path: str, checkpoint: str, model: str | None = None, **ask_args) -> StreamingQuery:
    """Judges a streaming table (a, b, prompt) batch by batch.  A pair that any earlier batch judged comes
    from the cache; each batch writes its own folder, so a batch run again after a failure replaces it."""

    def batch(df: DataFrame, number: int) -> None:
        cache = read_cache_table(df.sparkSession, cache_path)
        done, news = judge_pairs(durable(df), cache, judge, model, **ask_args)
        done = durable(done)
        done.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        fresh = done.where("error is null").select("key", "is_similar", "score").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
        append_cache(durable(fresh), cache_path)

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
