"""Judged edge contraction of a k-NN graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.scalars import same_cluster_strict
from weft.operators.graph import connected_components
from weft.operators.metrics import labelled


def contract(edges: DataFrame, records: DataFrame, id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """(id, component) when every edge has been judged by gold and contracted or dropped.

    Gold equality is an equivalence, so nodes stay pure and the end does not depend on the order: it is the
    components of the edges inside gold clusters.
    """
    same = labelled(edges.select("a", "b"), records, id_col, cluster_col).where(same_cluster_strict(F.col("ca"), F.col("cb")))
    return connected_components(same, records.select(F.col(id_col).alias("id")), "a", "b")


def contract_steps(edges: list[tuple], judge: Callable[[frozenset, frozenset], bool], max_iterations: int | None = None) -> tuple[list[frozenset], set[tuple], int]:
    """The loop itself, for small graphs on the driver and for a bounded number of iterations: (nodes as sets
    of ids, discovered pairs, iterations).  In each iteration the edge with most common neighbours, the
    smallest first among equals, is judged; a match joins its ends under the smaller one, else the edge goes."""
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    ids = {v: frozenset([v]) for v in near}
    pairs: set[tuple] = set()
    done = 0
    while any(near.values()) and (max_iterations is None or done < max_iterations):
        done += 1
        a, b = max(((a, b) for a in near for b in near[a] if a < b), key=lambda e: (len(near[e[0]] & near[e[1]]), [-x if isinstance(x, int) else 0 for x in e]))
        near[a].discard(b)
        near[b].discard(a)
        if judge(ids[a], ids[b]):
            pairs |= {(min(x, y), max(x, y)) for x in ids[a] for y in ids[b]}
            ids[a] |= ids.pop(b)
            for v in near.pop(b):
                near[v].discard(b)
                near[v].add(a)
                near[a].add(v)
    return list(ids.values()), pairs, done
