"""Near-duplicates by b-bit MinHash: bands name candidates, packed low bits estimate, full sets confirm."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import connected_components
from weft.session import broadcast_if_few, durable, slices

#: Words of a shingle.
WIDTH = 5
#: Minima of a signature; two low bits of each are kept, 32 minima to a long.
HASHES, BITS = 128, 2
#: Minima of a band, at most, and the share of pairs at the least similarity of a link that may have no band in
#: common: at 0.85, 25 bands of 5 miss one in 2 million; at 0.80, 32 bands of 4 miss one in 20 million.
ROWS, MISSED = 5, 1e-6
LONGS = HASHES * BITS // 64
#: Pairs whose estimate is this many standard errors under the least similarity of a link are not confirmed.
ERRORS = 6.5
#: Ids up to this number are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rows of a bucket's side, and pairs of a leader, that meet in one task: larger ones are cut by hash.
MEETING_ROWS = 4096
#: Minima of the wide signature of documents in buckets of several components.
WIDE = 2048
#: Word hashes that a worker keeps, of words up to so many bytes; a worker outlives the stage, and so does its table.
KEEP_WORDS, KEEP_BYTES = 1 << 16, 64

_rng = np.random.Generator(np.random.PCG64(20240229))
_MIX = _rng.integers(1, 1 << 63, size=WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(1, 1 << 63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, size=HASHES, dtype=np.uint64)
_WA = _rng.integers(1, 1 << 63, size=WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WB = _rng.integers(0, 1 << 63, size=WIDE, dtype=np.uint64)
_BAND = _rng.integers(1, 1 << 63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, :]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= KEEP_BYTES:
            if len(self) >= KEEP_WORDS:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes.

    A-Z is lower-cased, words are runs of anything but ASCII white space, a shingle is five words; a text of
    one to four words has one shingle, all of it; a null text or one without words has none.
    """
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < WIDTH:
        h = (w * _MIX[:n]).sum(keepdims=True) + np.uint64(n)
    else:
        m = n - WIDTH + 1
        h = w[:m] * _MIX[0]
        for j in range(1, WIDTH):
            h += w[j : j + m] * _MIX[j]
    return np.unique(_mixed(h))


def minima(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // len(a))
    for i in range(0, len(shingles), step):
        np.minimum(least, (shingles[i : i + step, None] * a + b).min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, packed into longs."""
    low = ((least >> np.uint64(32)) & np.uint64(3)).reshape(-1, 32)
    return (low << _SHIFT).sum(axis=1, dtype=np.uint64)


def band_rows(percent: int) -> int:
    """The most minima a band may have, up to ROWS, for a pair at ``percent`` to have no band in common at most
    MISSED times; one where even that is more."""
    fits = (r for r in range(ROWS, 1, -1) if (1 - (percent / 100) ** r) ** (HASHES // r) <= MISSED)
    return next(fits, 1)


def least_estimate(percent: int, hashes: int) -> float:
    """The estimate from ``hashes`` minima that is ERRORS standard errors under ``percent``."""
    chance = 1 / 2**BITS
    agree = chance + (1 - chance) * percent / 100
    return percent / 100 - ERRORS * math.sqrt(agree * (1 - agree) / hashes) / (1 - chance)


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n = len(least) // rows
    return _mixed((least[: n * rows] * _BAND[: n * rows]).reshape(n, rows).sum(axis=1, dtype=np.uint64))


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key, s0.., bands) per row; set_key is a 128-bit digest of the set, null with
    the bands where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size, key, sig, bands = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py())
                size.append(len(s))
                if len(s):
                    least = minima(s)
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(packed(least))
                    bands.append(band_keys(least, rows).view(np.int64))
                else:
                    key.append(None)
                    sig.append(np.zeros(LONGS, np.uint64))
                    bands.append(None)
            sig = np.array(sig, np.uint64).reshape(-1, LONGS).view(np.int64)
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), *[pa.array(sig[:, i]) for i in range(LONGS)], pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(cols, names=["doc_id", "n_shingles", "set_key", *[f"s{i}" for i in range(LONGS)], "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    sigs = ", ".join(f"s{i} bigint" for i in range(LONGS))
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_key binary, {sigs}, bands array<bigint>")


def wide_signatures(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, w0, w1, …): WIDE minima of two bits of the documents in ``ids`` (rep)."""
    names = [f"w{i}" for i in range(WIDE // 32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sig = [packed(minima(s, _WA, _WB)) if len(s := shingle_set(t.as_py())) else np.zeros(WIDE // 32, np.uint64) for t in b.column(1)]
            sig = np.array(sig, np.uint64).reshape(-1, WIDE // 32).view(np.int64)
            yield pa.record_batch([b.column(0), *[pa.array(sig[:, i]) for i in range(WIDE // 32)]], names=["rep", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    out = texts_of(docs, ids.withColumnRenamed("rep", "_id"), id_col, text_col).mapInArrow(run, f"rep {kind}, " + ", ".join(f"{w} bigint" for w in names))
    return durable(out.dropDuplicates(["rep"]))


def estimate(a: str, b: str, letter: str = "s", hashes: int = HASHES) -> Column:
    """Similarity from the packed bits of two rows (column prefixes ``a`` and ``b``), corrected for the
    quarter of unequal minima whose two bits agree."""
    x = [F.col(f"{a}{letter}{i}").bitwiseXOR(F.col(f"{b}{letter}{i}")) for i in range(hashes // 32)]
    differ = sum((F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x5555555555555555))) for v in x), F.lit(0))
    chance = 1 / 2**BITS
    return ((1 - differ / hashes) - chance) / (1 - chance)


def possible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and estimate leave a link open."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (estimate(a, b) >= least_estimate(percent, HASHES))


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text) of the documents in ``ids`` (_id)."""
    wanted = broadcast_if_few(ids, BROADCAST_IDS)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(wanted, "_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The ``pairs`` (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Sets are made anew from the texts of the documents in pairs.  The pairs of a document with many are cut by
    hash, and its set goes to each part once.
    """
    pairs = durable(pairs)
    ids = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    texts = texts_of(docs, ids, id_col, text_col)

    def to_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([b.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["_id", "_set"])

    kind = docs.schema[id_col].dataType.simpleString()
    sets = durable(texts.mapInArrow(to_set, f"_id {kind}, _set binary").dropDuplicates(["_id"]))
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEETING_ROWS).alias("_parts")).where("_parts > 1")
    many = broadcast_if_few(many)
    cut = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("_parts")), F.lit(0)).cast("long").alias("_part"))
    spread = sets.toDF("a", "_set_a").join(many, "a", "left").select("a", "_set_a", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1)).alias("_part"))
    both = cut.join(sets.toDF("b", "_set_b"), "b").join(spread, ["a", "_part"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return durable(both.select("a", "b", "_set_a", "_set_b").mapInArrow(check, f"a {kind}, b {kind}"))


def meetings(rows: DataFrame, meta, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of rows (key, rep, comp) with one key and different components that sizes, estimate and
    wide estimate leave open.  Rows outside their key's largest component meet all others; those inside it
    don't meet each other, and keys with one component drop out.  Both sides of a large bucket are cut by hash
    and each part meets each, so no task has more than MEETING_ROWS of either.  The estimates are join conditions, so what
    they rule out is never a row, and a pair of several common keys comes from the least of them only."""
    tally = rows.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("rows"), F.count(F.lit(1)).alias("n_comps"))
    parts = lambda n: F.ceil(n / MEETING_ROWS).cast("int")
    tally = tally.where("n_comps > 1").select("key", F.col("top.comp").alias("major"), parts(F.col("rows") - F.col("top.count")).alias("outer_parts"), parts(F.col("rows")).alias("all_parts"))
    some = durable(rows.join(tally, "key"))
    wide = wide_signatures(docs, some.select("rep").distinct(), id_col, text_col)
    ws = [w for w in wide.columns if w != "rep"]
    side = lambda df, p, key, comp: df.join(meta(p, "rep", "bands"), "rep").join(wide.toDF("rep", *[p + w for w in ws]), "rep").withColumnsRenamed({"rep": key, "comp": comp})
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = some.where("comp <> major").withColumn("px", part("outer_parts")).withColumn("py", every("all_parts"))
    others = some.withColumn("is_major", F.col("comp") == F.col("major")).withColumn("py", part("all_parts")).withColumn("px", every("outer_parts"))
    drop = ("major", "outer_parts", "all_parts")
    left, right = side(outer.drop(*drop), "x", "a", "ca"), side(others.drop(*drop), "y", "b", "cb")
    wanted = (F.col("ca") != F.col("cb")) & (F.col("is_major") | (F.col("a") < F.col("b"))) & possible("x", "y", percent) & (estimate("x", "y", "w", WIDE) >= least_estimate(percent, WIDE))
    once = F.array_min(F.array_intersect("xbands", "ybands")) == left["key"]
    same = (left["key"] == right["key"]) & (left["px"] == right["px"]) & (left["py"] == right["py"])
    met = left.join(right, same & wanted & once)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest doc_id reachable, kept says whether it is the document's own.

    1. Documents of equal sets are one class, held by its smallest doc_id; only classes go on.
    2. In every band bucket each member is paired with the bucket's smallest member: as many pairs as
       members.  Pairs that estimate and sizes leave open are confirmed on full sets; links are joined to
       components.
    3. A bucket may still hold several components, and links between members that are neither's smallest.
       In such a bucket the members outside its largest component meet every member of another component,
       with sizes and estimates, here also that of a wider signature, as join condition.  So every pair in a
       bucket is in one component already or looked at, and no bucket has a cap; pairs that the estimates
       rule out are compared but never made.  What remains to miss a link is a pair without a common band.

    Null text, or one without words: n_shingles 0, linked with nothing.  Rows repeating a doc_id are the
    same document, so their texts must be equal; give each row a key of its own where they aren't.  A null doc_id is never a component's id unless its class has no other; it is kept then.
    Empty input: empty output.  Other columns are ignored.
    """
    sketches = durable(sketch_documents(docs, id_col, text_col, band_rows(percent)))
    classes = durable(sketches.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    sigs = [f"s{i}" for i in range(LONGS)]
    one = sketches.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"])
    reps = durable(one.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), *sigs, "bands"))
    meta = lambda p, key, *more: reps.select(F.col("rep").alias(key), F.col("n").alias(f"{p}n"), *[F.col(s).alias(f"{p}{s}") for s in (*sigs, *more)])

    banded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = durable(banded.join(buckets.drop("size"), "key"))
    pairs = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = durable(pairs.join(meta("y", "b"), "b").join(meta("x", "a"), "a").where(possible("x", "y", percent)).select("a", "b"))
    links = confirm(pairs, docs, percent, id_col, text_col)
    found = durable(connected_components(links, a="a", b="b"))

    label = members.join(found.toDF("rep", "comp"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    more = meetings(durable(label), meta, docs, percent, id_col, text_col)
    more = durable(more.join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        extra = confirm(more, docs, percent, id_col, text_col)
        if not extra.isEmpty():
            found = durable(connected_components(links.unionByName(extra), a="a", b="b"))

    of_class = classes.join(found.toDF("rep", "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
