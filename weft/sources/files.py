"""Pair, score, cache and vector files: readers with their rules for bad rows, and the writers."""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.judgement import score_or_skip, score_or_zero, truth
from weft.session import exists, storage


def _csv(spark: SparkSession, path: str, needs: tuple[str, ...]) -> DataFrame:
    """A CSV file with a header, all strings; raises if a column is missing."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.lstrip("﻿") for c in df.columns]
    df = df.toDF(*names)
    if missing := [c for c in needs if c not in names]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return df


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(value): whole files of a path, none where there is nothing."""
    return spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, label) of JSON arrays of three-element arrays; nothing where a file is missing or broken."""
    doc = documents(spark, path).select(F.from_json("value", "array<array<string>>").alias("rows"))
    return doc.select(F.explode("rows").alias("r")).where(F.size("r") == 3).select(F.col("r")[0].alias("a"), F.col("r")[1].alias("b"), F.col("r")[2].cast("int").alias("label"))


class _Plain(pickle.Unpickler):
    """Of pickles only what needs no class: lists and strings."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} in an id list")


@lru_cache(maxsize=2)
def read_ids(path: str) -> list[str]:
    """The ids of a matrix file: a JSON array, or a pickled list of strings."""
    store, at = storage(path)
    with store.open_input_stream(at, compression=None) as f:
        data = f.read()
    ids = json.loads(data) if data[:1] in b"[ \n" else _Plain(io.BytesIO(data)).load()
    return [str(i) for i in ids]


def _matrix(path: str) -> tuple[tuple[int, int], np.dtype, int]:
    """(shape, type, offset of the first row) of a matrix file; one vector may be one-dimensional."""
    store, at = storage(path)
    with store.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        start = f.tell()
    shape = (1, *shape) if len(shape) == 1 else shape
    if len(shape) != 2 or fortran and min(shape) > 1:
        raise ValueError(f"{path}: shape {shape}, or columns first")
    return shape, kind, start


def read_vectors(spark: SparkSession, npy: str, ids: list[str] | str | None = None, rows: int = 65536) -> DataFrame:
    """(id, embedding) of a matrix file and its ids, a list or a file; or of a folder of write_vectors.  Tasks
    read ``rows`` rows each at their place in the file; the driver reads headers only."""
    if ids is None:
        store, at = storage(npy)
        parts = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".npy"))
        files = [(p, p.removesuffix(".npy") + ".ids.json") for p in parts]
    else:
        files = [(npy, ids if isinstance(ids, str) else None)]
    jobs = []
    for path, names in files:
        (n, _), _, _ = _matrix(path)
        if names is None and len(ids) != n:
            raise ValueError(f"{path}: {n} rows for {len(ids)} ids")
        jobs += [(path, names, a, min(n, a + rows), None if names else ids[a : a + rows]) for a in range(0, n, rows)]
    if not jobs:
        return spark.createDataFrame([], "id string, embedding array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, names, first, last, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                (n, dim), kind, start = _matrix(path)
                known = own if own is not None else read_ids(names)
                if own is None and len(known) != n:
                    raise ValueError(f"{path}: {n} rows for {len(known)} ids")
                store, at = storage(path)
                with store.open_input_file(at) as f:
                    data = f.read_at((last - first) * dim * kind.itemsize, start + first * dim * kind.itemsize)
                x = np.frombuffer(data, kind).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dim, dtype=np.int32)), pa.array(x))
                yield pa.record_batch([pa.array(own if own is not None else known[first:last], pa.string()), vectors], names=["id", "embedding"])

    todo = spark.createDataFrame(jobs, "path string, names string, first bigint, last bigint, own array<string>").repartition(min(len(jobs), 10_000))
    return todo.mapInArrow(run, "id string, embedding array<float>")


def write_vectors(vectors: DataFrame, folder: str) -> int:
    """(id, embedding) as matrix files with their ids beside them, a pair a partition; the number of rows.  Run
    again, a task replaces its files."""
    dim = vectors.agg(F.max(F.size("embedding")).alias("d")).first()["d"]
    if dim is None:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            parts.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32))
        if ids:
            store, at = storage(folder)
            store.create_dir(at, recursive=True)
            name = f"{at}/part-{TaskContext.get().partitionId():05d}"
            buffer = io.BytesIO()
            np.save(buffer, np.concatenate(parts).reshape(len(ids), dim))
            for suffix, data in ((".npy", buffer.getvalue()), (".ids.json", json.dumps(ids, ensure_ascii=False).encode())):
                with store.open_output_stream(name + suffix, compression=None) as f:
                    f.write(data)
        yield pa.record_batch([pa.array([len(ids)], pa.int64())], names=["n"])

    rows = vectors.where("embedding is not null").select(F.col("id").cast("string"), F.col("embedding").cast("array<float>"))
    return rows.mapInArrow(run, "n bigint").agg(F.sum("n").alias("n")).first()["n"] or 0


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file of word vectors (.vec, also .vec.gz): a word and its numbers a line; the
    first line, which says how many there are, and lines of another length are left out."""
    lines = spark.read.text(path).select(F.split("value", " ").alias("x"))
    rows = lines.select(F.col("x")[0].alias("word"), F.transform(F.filter(F.slice("x", 2, 1 << 20), lambda v: v != ""), lambda v: v.try_cast("float")).alias("vector"))
    return rows.where((F.size("vector") > 1) & ~F.exists("vector", lambda v: v.isNull()))


def read_candidate_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of a candidate CSV."""
    return _csv(spark, path, ("record_id_1", "record_id_2")).select(F.col("record_id_1").alias("a"), F.col("record_id_2").alias("b"))


def read_scores(spark: SparkSession, path: str, score: str = "llm_similarity_score") -> DataFrame:
    """(a, b, score), a < b: empty scores are 0, rows whose score is no number are dropped, and of a pair's
    rows the last counts."""
    # Files in the order of their names; a multi-line file is one task's, whose row numbers ascend.
    df = _csv(spark, path, ("record_id_1", "record_id_2")).withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    value = score_or_skip(F.col(score), ("", "none")) if score in df.columns else F.lit(0.0)
    rows = df.select(F.least("record_id_1", "record_id_2").alias("a"), F.greatest("record_id_1", "record_id_2").alias("b"), value.alias("score"), F.struct("_file", "_at").alias("n"))
    return rows.where("score is not null").groupBy("a", "b").agg(F.max_by("score", "n").alias("score"))


#: What a cache of judgements may say of a pair.
JUDGEMENT = "is_similar boolean, score double, llm_prompt string, llm_raw_response string, llm_judgement string, llm_similarity_score double, llm_reason string, processed_at string"


def read_cache(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """(key, is_similar, score, …) of a cache: JSON maps of judgements, or what append_cache wrote; with
    ``model`` only its keys.  Nothing where it is missing or broken."""
    kinds = [f.split(" ") for f in JUDGEMENT.split(", ")]
    value = "struct<" + ",".join(f"{n}:{k}" for n, k in kinds) + ">"
    if _parquet(spark, path):
        found = spark.read.option("mergeSchema", True).parquet(path)
        rows = found.select("key", *[F.col(n) if n in found.columns else F.lit(None).cast(k).alias(n) for n, k in kinds])
    else:
        rows = documents(spark, path).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v")).select("key", "v.*")
    return rows.where(F.col("key").contains(model)) if model else rows


def _listing(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(p)] if store.exists(p) and store.getFileStatus(p).isDirectory() else []


def _parquet(spark: SparkSession, path: str) -> bool:
    return any(n.endswith(".parquet") for n in _listing(spark, path))


def read_review_candidates(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, ("record_id_1", "record_id_2", "llm_similarity_score", "same_cluster_ground_truth"))
    gold = F.lower("same_cluster_ground_truth")
    rows = df.select(
        F.col("record_id_1").alias("a"), F.col("record_id_2").alias("b"), score_or_skip(F.col("llm_similarity_score"), ("", "none", "n/a")).alias("score"),
        F.when(gold == "true", True).when(gold == "false", False).alias("gold"),
    )
    return rows.where("score is not null")


def read_simulation(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, label) of rows with both ids and a true or false label."""
    df = _csv(spark, path, ("record_id_1", "record_id_2", "simulated_human_judgement"))
    word = F.lower("simulated_human_judgement")
    rows = df.where("record_id_1 <> '' and record_id_2 <> ''").where(word.isin("true", "false"))
    return rows.select(F.col("record_id_1").alias("a"), F.col("record_id_2").alias("b"), (word == "true").alias("label"))


def read_detailed_results(spark: SparkSession, path: str, score: str = "score_before") -> DataFrame:
    """(a, b, gold, predicted, score) for score analysis: odd truth words count as true, rows without a
    score are dropped."""
    df = _csv(spark, path, ("record_id_1", "record_id_2", score))
    predicted = next((c for c in ("predicted_similar_before", "predicted_similar") if c in df.columns), None)
    flag = lambda c: truth(F.col(c)) if c and c in df.columns else F.lit(None).cast("boolean")
    rows = df.select(F.col("record_id_1").alias("a"), F.col("record_id_2").alias("b"), flag("ground_truth_similar").alias("gold"), flag(predicted).alias("predicted"), F.col(score).try_cast("double").alias("score"))
    return rows.where("score is not null")


def triangle_input(results: DataFrame, score: str = "score_before") -> DataFrame:
    """(record_id_1, record_id_2, llm_similarity_score), anything unreadable as 0."""
    return results.select("record_id_1", "record_id_2", score_or_zero(F.col(score)).alias("llm_similarity_score"))


# Sinks


def write_csv(df: DataFrame, path: str, sort: tuple[str, ...] = ()) -> None:
    """CSV with a header, sorted across files if asked; nothing is written for an empty table."""
    if df.isEmpty():
        return
    out = df.orderBy(*sort) if sort else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, column: str | None = None) -> None:
    """One JSON object a line: the rows, or a column that holds JSON already."""
    if column:
        df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def json_text(c: Column) -> Column:
    """A string as JSON writes it."""
    one = F.to_json(F.array(c.cast("string")))
    return F.substr(one, F.lit(2), F.length(one) - 2)


def write_documents(rows: DataFrame, path: str, brackets: str = "[]", files: int | None = None) -> None:
    """JSON documents, one a partition and each whole: the elements of column value in brackets.  ``files`` makes
    fewer of them: 1 for tools that read a single file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([brackets[0]])], names=["value"])
        first = True
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array([v if first and not i else f",{v}" for i, v in enumerate(b.column(0).to_pylist())])], names=["value"])
                first = False
        yield pa.record_batch([pa.array([brackets[1]])], names=["value"])

    rows = rows.select("value")
    (rows.coalesce(files) if files else rows).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_labelled_pairs(pairs: DataFrame, path: str, files: int | None = None) -> None:
    """Arrays of [a, b, label]."""
    row = F.concat(F.lit("["), json_text(F.col("a")), F.lit(", "), json_text(F.col("b")), F.lit(", "), F.col("label").cast("string"), F.lit("]"))
    write_documents(pairs.select(row.alias("value")), path, "[]", files)


def write_cache(cache: DataFrame, path: str, files: int | None = None) -> None:
    """A cache as JSON maps, {key: judgement}; keys are unique."""
    fields = F.struct(*[c for c in cache.columns if c != "key"])
    write_documents(cache.select(F.concat(json_text(F.col("key")), F.lit(": "), F.to_json(fields)).alias("value")), path, "{}", files)


def append_cache(news: DataFrame, path: str) -> None:
    """New judgements next to those of earlier runs."""
    news.write.mode("append").parquet(path)
