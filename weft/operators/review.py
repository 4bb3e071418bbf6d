"""Active learning: inconsistent triangles, simulated review, fine-tuning samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.judgement import NO, SCORE_KEY, YES, by_threshold
from weft.functions.scalars import inconsistency, same_cluster, uniform
from weft.functions.text import SYSTEM_PROMPT
from weft.operators.graph import triangles
from weft.operators.metrics import labelled

BUDGET = 300


def top_triangles(scored: DataFrame, records: DataFrame, budget: int = BUDGET, id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """The ``budget`` // 3 least consistent triangles of scored edges (a, b, score), with clusters and gold
    flags of their edges (null where a cluster is unknown)."""
    t = triangles(scored).withColumn("inconsistency", inconsistency(F.col("p_uv"), F.col("p_vw"), F.col("p_wu")))
    t = t.orderBy(F.desc("inconsistency"), "u", "v", "w").limit(budget // 3)
    c = records.select(F.col(id_col).alias("u"), F.col(cluster_col).alias("cluster_u"))
    t = t.join(c, "u", "left").join(c.toDF("v", "cluster_v"), "v", "left").join(c.toDF("w", "cluster_w"), "w", "left")
    flags = [same_cluster(F.col(f"cluster_{x}"), F.col(f"cluster_{y}")).alias(f"true_{x}{y}") for x, y in ("uv", "vw", "wu")]
    return t.select("u", "v", "w", "inconsistency", "p_uv", "p_vw", "p_wu", *flags, "cluster_u", "cluster_v", "cluster_w")


def review_pairs(top: DataFrame, records: DataFrame, id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """(a, b, score, ca, cb, gold): the distinct edges of the triangles, with clusters and gold flag."""
    edge = lambda x, y, p: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(p).alias("score"))
    edges = top.select(F.explode(F.array(edge("u", "v", "p_uv"), edge("v", "w", "p_vw"), edge("u", "w", "p_wu"))).alias("e")).select("e.*").distinct()
    return labelled(edges, records, id_col, cluster_col).withColumn("gold", same_cluster(F.col("ca"), F.col("cb"))).select("a", "b", "score", "ca", "cb", "gold")


def human(gold: Column, accuracy: float, u: Column) -> Column:
    """The reviewer's answer: gold with probability ``accuracy``, else its contrary."""
    if not 0.0 <= accuracy <= 1.0:
        raise ValueError("accuracy must be between 0 and 1")
    return F.when(u < accuracy, gold).otherwise(~gold)


def simulate_review(pairs: DataFrame, accuracy: float = 1.0, seed: str = "review") -> DataFrame:
    """Review pairs (a, b, score, gold) with the judge's and a simulated reviewer's answers and who is right;
    nulls where gold is unknown."""
    judged = by_threshold(F.col("score"))
    answer = human(F.col("gold"), accuracy, uniform(seed, F.col("a"), F.col("b")))
    rows = pairs.select("a", "b", "score", judged.alias("judged"), "gold", F.lit(accuracy).alias("accuracy"), answer.alias("human"))
    right = F.col("judged") == F.col("gold")
    return rows.withColumn("judge_right", right).withColumn("human_right", F.col("human") == F.col("gold")).withColumn("corrected", ~right & (F.col("human") == F.col("gold")))


def simulation_stats(rows: DataFrame) -> DataFrame:
    """One row of counts over pairs of known gold."""
    return rows.where("gold is not null").agg(
        F.count(F.lit(1)).alias("known"), F.count_if("judge_right").alias("judge_right"), F.count_if("human_right").alias("human_right"),
        F.count_if(~F.col("judge_right")).alias("judge_wrong"), F.count_if("corrected").alias("corrected"),
    )


def finetune_messages(pairs: DataFrame, prompt: Column, label: Column) -> DataFrame:
    """(messages): a chat sample as JSON for each pair: system, question, and the answer by ``label``."""
    answer = F.when(label, f"{YES}\n{SCORE_KEY} 1.0").otherwise(f"{NO}\n{SCORE_KEY} 0.0")
    part = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return pairs.select(F.to_json(F.struct(F.array(part("system", F.lit(SYSTEM_PROMPT)), part("user", prompt), part("assistant", answer)).alias("messages"))).alias("sample"))
