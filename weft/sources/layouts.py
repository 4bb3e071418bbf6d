"""Result files in the layouts that the workflow's other tools read: their columns, their names, and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.judgement import score_or_skip, truth
from weft.session import storage
from weft.sources.files import _csv, write_csv

# Columns of the files: fixed values.
RESULTS = ("record_id_1", "record_id_2", "bib_info_1", "bib_info_2", "llm_prompt", "llm_raw_response", "llm_judgement", "llm_similarity_score", "llm_reason", "status")
DETAILED = ("record_id_1", "record_id_2", "ground_truth_similar", "predicted_similar_before", "score_before", "error_before", "predicted_similar_after", "score_after", "error_after")
DETAILED_ONE = ("record_id_1", "record_id_2", "ground_truth_similar", "predicted_similar", "llm_score", "error")
TRIANGLES = (
    "triangle_node1", "triangle_node2", "triangle_node3", "inconsistency_score", "p_edge12", "p_edge23", "p_edge31",
    "true_edge12", "true_edge23", "true_edge31", "cluster_id1", "cluster_id2", "cluster_id3",
)
REVIEW = ("record_id_1", "record_id_2", "llm_similarity_score", "cluster_id_1", "cluster_id_2", "same_cluster_ground_truth")
SIMULATION = (
    "record_id_1", "record_id_2", "original_llm_score", "original_llm_judgement", "ground_truth_label", "simulated_human_accuracy",
    "simulated_human_judgement", "is_llm_correct_vs_gt", "is_human_correct_vs_gt", "human_corrected_llm_error",
)
UNKNOWN = "N/A"


def _word(flag: Column) -> Column:
    """A flag as these files write it."""
    return F.when(flag, "True").when(~flag, "False")


def results(explained: DataFrame, details: DataFrame) -> DataFrame:
    """RESULTS of explained pairs (a, b, prompt, answer, judgement, score, reason, status) and records' texts
    (id, details); a record without one leaves it empty, a missing status is unknown."""
    both = explained.join(details.toDF("a", "_one"), "a", "left").join(details.toDF("b", "_two"), "b", "left")
    return both.select("a", "b", "_one", "_two", "prompt", "answer", "judgement", "score", "reason", F.coalesce("status", F.lit("unknown"))).toDF(*RESULTS)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """RESULTS back as (a, b, prompt, answer, judgement, score, reason, status); status may be missing."""
    df = _csv(spark, path, RESULTS[:-1])
    status = F.col("status") if "status" in df.columns else F.lit("unknown")
    return df.select(
        F.col("record_id_1").alias("a"), F.col("record_id_2").alias("b"), F.col("llm_prompt").alias("prompt"), F.col("llm_raw_response").alias("answer"),
        F.col("llm_judgement").alias("judgement"), F.col("llm_similarity_score").try_cast("double").alias("score"), F.col("llm_reason").alias("reason"), status.alias("status"),
    )


def detailed(gold: DataFrame, before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """DETAILED, or DETAILED_ONE without ``after``: pairs with gold (a, b, gold) and one or two models'
    predictions (a, b, predicted, score, error), joined by pair.  Pairs that the second model lacks stay."""
    rows = gold.join(before.toDF("a", "b", "p1", "s1", "e1"), ["a", "b"])
    columns = ["a", "b", _word(F.col("gold")), _word(F.col("p1")), "s1", "e1"]
    if after is None:
        return rows.select(*columns).toDF(*DETAILED_ONE)
    rows = rows.join(after.toDF("a", "b", "p2", "s2", "e2"), ["a", "b"], "left")
    return rows.select(*columns, _word(F.col("p2")), "s2", "e2").toDF(*DETAILED)


def read_detailed(spark: SparkSession, path: str) -> DataFrame:
    """Either of them back: (a, b, gold, predicted, score, error) and for two models the same with _after."""
    df = _csv(spark, path, ("record_id_1", "record_id_2", "ground_truth_similar"))
    two = "predicted_similar_before" in df.columns
    flag = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), truth(F.col(c)))
    first = [flag(DETAILED[3] if two else DETAILED_ONE[3]).alias("predicted"), F.col(DETAILED[4] if two else DETAILED_ONE[4]).try_cast("double").alias("score"), F.col(DETAILED[5] if two else DETAILED_ONE[5]).alias("error")]
    second = [flag(DETAILED[6]).alias("predicted_after"), F.col(DETAILED[7]).try_cast("double").alias("score_after"), F.col(DETAILED[8]).alias("error_after")] if two else []
    return df.select(F.col("record_id_1").alias("a"), F.col("record_id_2").alias("b"), flag("ground_truth_similar").alias("gold"), *first, *second)


def triangles(top: DataFrame) -> DataFrame:
    """TRIANGLES of review.top_triangles."""
    flags = [_word(F.col(c)) for c in ("true_uv", "true_vw", "true_wu")]
    return top.select("u", "v", "w", "inconsistency", "p_uv", "p_vw", "p_wu", *flags, "cluster_u", "cluster_v", "cluster_w").toDF(*TRIANGLES)


def review(pairs: DataFrame) -> DataFrame:
    """REVIEW of review.review_pairs; an unknown score or cluster reads N/A."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in ("score", "ca", "cb")]
    return pairs.select("a", "b", *known, _word(F.col("gold"))).toDF(*REVIEW)


def simulation(rows: DataFrame) -> DataFrame:
    """SIMULATION of review.simulate_review."""
    flags = [_word(F.col(c)) for c in ("judged", "gold")]
    return rows.select("a", "b", "score", *flags, "accuracy", *[_word(F.col(c)) for c in ("human", "judge_right", "human_right", "corrected")]).toDF(*SIMULATION)


def read_simulation_file(spark: SparkSession, path: str) -> DataFrame:
    """SIMULATION back as (a, b, score, judged, gold, accuracy, human, judge_right, human_right, corrected)."""
    df = _csv(spark, path, SIMULATION)
    flag = lambda c, n: F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False).alias(n)
    return df.select(
        F.col("record_id_1").alias("a"), F.col("record_id_2").alias("b"), score_or_skip(F.col("original_llm_score"), ("", "none")).alias("score"),
        flag("original_llm_judgement", "judged"), flag("ground_truth_label", "gold"), F.col("simulated_human_accuracy").try_cast("double").alias("accuracy"),
        flag("simulated_human_judgement", "human"), flag("is_llm_correct_vs_gt", "judge_right"), flag("is_human_correct_vs_gt", "human_right"), flag("human_corrected_llm_error", "corrected"),
    )


def simulation_name(accuracy: float, stem: str = "review_simulation") -> str:
    """A file name by the reviewer's accuracy in percent."""
    return f"{stem}_{accuracy * 100:.0f}.csv"


def write_simulations(by_accuracy: dict[float, DataFrame], folder: str) -> list[str]:
    """A file for each accuracy; the paths of those that have rows."""
    done = []
    for accuracy, rows in by_accuracy.items():
        if not rows.isEmpty():
            done.append(f"{folder}/{simulation_name(accuracy)}")
            write_csv(simulation(rows), done[-1], ("record_id_1", "record_id_2"))
    return done


# Reports


def markdown(rows: DataFrame, order: Sequence[str] = ()) -> str:
    """A bounded table, such as the score bins, as Markdown."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [list(map(cell, r)) for r in (rows.orderBy(*order) if order else rows).collect()]
    width = [max(len(r[i]) for r in [rows.columns, *lines]) for i in range(len(rows.columns))]
    line = lambda r: "| " + " | ".join(x.ljust(n) for x, n in zip(r, width, strict=True)) + " |"
    return "\n".join([line(rows.columns), line(["-" * n for n in width]), *map(line, lines)])


def performance_report(title: str, inputs: dict[str, object], models: dict[str, dict[str, DataFrame]], date: str) -> str:
    """The text of a report.  ``models``: by model the one-row tables that there are of pairs (tp, fp, fn, tn,
    precision, recall, f1), errors (errors), clusters (ari, nmi, homogeneity, completeness, v_measure) and all
    pairs (as pairs)."""
    out = [f"# {title}", f"date: {date}", "", "## Inputs", *[f"- {k}: {v}" for k, v in inputs.items()]]
    for model, tables in models.items():
        out += ["", f"## {model}"]
        for name, table in tables.items():
            row = table.first().asDict()
            out += ["", f"### {name}"]
            if {"tp", "fp", "fn", "tn"} <= row.keys():
                out += ["| | predicted positive | predicted negative |", "| - | - | - |", f"| actual positive | TP {row['tp']} | FN {row['fn']} |", f"| actual negative | FP {row['fp']} | TN {row['tn']} |"]
            out += [f"- {k}: {v:.4f}" if isinstance(v, float) else f"- {k}: {v}" for k, v in row.items() if k not in ("tp", "fp", "fn", "tn")]
    return "\n".join(out) + "\n"


def write_text(text: str, path: str) -> None:
    """A small text as one file, in any store that Arrow opens."""
    store, at = storage(path)
    with store.open_output_stream(at, compression=None) as f:
        f.write(text.encode("utf-8"))
