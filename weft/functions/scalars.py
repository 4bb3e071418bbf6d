"""Small column expressions over pairs, scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORPHAN = "gt_orphan_"


def cache_key(a: Column, b: Column, model: Column | None = None) -> Column:
    """The key of an unordered pair, with the judging model if there is one."""
    a, b = a.cast("string"), b.cast("string")
    parts = [F.least(a, b), F.greatest(a, b)] + ([model] if model is not None else [])
    return F.concat_ws("_", *parts)


def gold_cluster(cluster: Column, record_id: Column) -> Column:
    """The cluster, or one of the record's own."""
    return F.coalesce(cluster.cast("string"), F.concat(F.lit(ORPHAN), record_id.cast("string")))


def same_cluster(a: Column, b: Column) -> Column:
    """True or false, or null if a cluster is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), a == b)


def same_cluster_strict(a: Column, b: Column) -> Column:
    """True only if both are present, equal and no orphan's."""
    return F.coalesce((a == b) & ~a.cast("string").startswith(ORPHAN), F.lit(False))


def inconsistency(uv: Column, vw: Column, wu: Column) -> Column:
    """How much of a triangle's probability has exactly two links."""
    return uv * vw * (1 - wu) + vw * wu * (1 - uv) + wu * uv * (1 - vw)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in double."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda s, d: s + d * d)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite if a vector is missing."""
    return F.coalesce(F.sqrt(squared_distance(a, b)), F.lit(float("inf")))


def contrastive(dist: Column, label: Column, margin: float = 1.0) -> Column:
    """The pair's loss: squared distance of a match, squared shortfall from the margin otherwise."""
    short = F.greatest(F.lit(0.0), F.lit(margin) - dist)
    return label * dist * dist + (1 - label) * short * short


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from md5 of the seed and the columns: the same in every run and engine."""
    key = F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_order(seed: str, *cols: Column) -> Column:
    """A random but fixed order of rows."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols]).cast("binary"))
