"""Pair judging with an injected judge, a cache and bounded concurrency."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.judgement import parse_judgement, parse_verdict
from weft.functions.scalars import cache_key


def cache_misses(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs (…, key) whose key isn't in the cache."""
    return pairs.join(cache.select("key").distinct(), "key", "left_anti")


def with_key(pairs: DataFrame, model: str | None = None) -> DataFrame:
    return pairs.withColumn("key", cache_key(F.col("a"), F.col("b"), F.lit(model) if model else None))


class RateLimited(Exception):
    """What a judge raises when its service asks to wait."""


def first_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pairs by (a, b), for a trial run; all of them if ``n`` is 0 or less."""
    return pairs.orderBy("a", "b").limit(n) if n > 0 else pairs


def _within(judge: Callable[[str], str], prompt: str, timeout: float | None) -> str:
    """The judge's answer, or TimeoutError after ``timeout`` seconds; the call itself is left to end unheard."""
    if timeout is None:
        return judge(prompt)
    said: queue.SimpleQueue = queue.SimpleQueue()

    def call() -> None:
        try:
            said.put((judge(prompt), None))
        except BaseException as e:  # handed over to the waiting thread
            said.put((None, e))

    threading.Thread(target=call, daemon=True).start()
    try:
        answer, error = said.get(timeout=timeout)
    except queue.Empty:
        raise TimeoutError(f"no answer in {timeout:g} s") from None
    if error is not None:
        raise error
    return answer


def ask(
    pairs: DataFrame,
    judge: Callable[[str], str],
    concurrency: int = 5,
    attempts: int = 1,
    pause: float = 0.0,
    timeout: float | None = 60.0,
    pace: float = 0.0,
    rate_wait: float = 5.0,
) -> DataFrame:
    """Pairs (key, prompt) with the judge's ``answer``, or the ``error`` of its last attempt.

    ``judge`` is called by at most ``concurrency`` threads in each task; the number of tasks bounds the rest.
    A call that takes more than ``timeout`` seconds is an error.  Each thread waits ``pace`` seconds after a
    call, ``pause`` more before a further attempt, and ``rate_wait`` instead after RateLimited.
    """

    def one(prompt: str) -> tuple[str | None, str | None]:
        error, wait = None, 0.0
        for k in range(attempts):
            if wait:
                time.sleep(wait)
            try:
                return _within(judge, prompt, timeout), None
            except RateLimited as e:
                error, wait = f"RateLimited: {e}", rate_wait
                if k + 1 == attempts:
                    time.sleep(wait)  # the service's other callers are spared too
            except Exception as e:  # what an external service raises becomes the row's error
                error, wait = f"{type(e).__name__}: {e}", pause
            finally:
                if pace:
                    time.sleep(pace)
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                got = list(pool.map(one, b.column("prompt").to_pylist()))
                yield pa.record_batch([b.column("key"), pa.array([a for a, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["key", "answer", "error"])

    return pairs.select("key", "prompt").mapInArrow(run, "key string, answer string, error string")


def judge_pairs(pairs: DataFrame, cache: DataFrame, judge: Callable[[str], str], model: str | None = None, **ask_args) -> tuple[DataFrame, DataFrame]:
    """(judged, news): every pair (a, b, prompt) with is_similar, score and error, and the cache rows to
    append.  Keys in the cache (key, is_similar, score) aren't asked; failed calls aren't cached; a pair
    asked twice is asked once."""
    keyed = with_key(pairs, model)
    todo = cache_misses(keyed, cache).dropDuplicates(["key"])
    said = ask(todo, judge, **ask_args).withColumn("v", parse_verdict(F.col("answer")))
    fresh = said.select("key", "v.is_similar", "v.score", F.coalesce("error", "v.error").alias("error"))
    news = fresh.where("error is null").select("key", "is_similar", "score")
    known = cache.select("key", "is_similar", "score", F.lit(None).cast("string").alias("error")).unionByName(fresh)
    return keyed.join(known, "key", "left").select("a", "b", "key", "is_similar", "score", "error"), news


def explain_pairs(pairs: DataFrame, judge: Callable[[str], str], **ask_args) -> DataFrame:
    """Pairs (a, b, prompt) with judgement, score and reason, and a status."""
    keyed = with_key(pairs)
    said = ask(keyed.dropDuplicates(["key"]), judge, **ask_args).withColumn("p", parse_judgement(F.col("answer")))
    status = F.when(F.col("error").isNull(), "ok").otherwise("error")
    said = said.select("key", "answer", "p.judgement", "p.score", "p.reason", "error", status.alias("status"))
    return keyed.join(said, "key", "left")


def predictions(judged: DataFrame) -> DataFrame:
    """(a, b, predicted, score): a failed judgement counts as not similar, 0."""
    return judged.select("a", "b", F.coalesce("is_similar", F.lit(False)).alias("predicted"), F.coalesce("score", F.lit(0.0)).alias("score"), "error")


def compare_models(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two models' predictions of the same pairs side by side, with their errors."""

    def side(df: DataFrame, name: str) -> DataFrame:
        error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
        return df.select("a", "b", F.col("predicted").alias(f"predicted_{name}"), F.col("score").alias(f"score_{name}"), error.alias(f"error_{name}"))

    return side(before, "before").join(side(after, "after"), ["a", "b"])
