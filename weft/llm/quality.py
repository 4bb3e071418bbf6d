"""Quality rules: a linear-chain CRF labels lines as content or boilerplate; the content share decides."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import slices

SPACE = b" \t\n\x0b\f\r"
SYMBOLS = b"#*$%&|<>"
ASCII_UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())

FEATURES = ("bias", "symbols", "exclamations", "bars", "upper", "digits", "letters", "few_words", "seen_before", "word_twice", "log_words")
#: Least share of a document's words that stands in content lines.
LEAST_CONTENT = 0.5
#: Bounds of the training sample: labelled documents, characters and lines of one.  The driver holds
#: documents x lines x features numbers at most, 35 MB.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_LINES = 1000, 10_000, 400


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    """Of a line with at least one word: shares between 0 and 1, times the weight of a line of its length,
    so that a long line isn't outvoted by short neighbours."""
    n = len(line)
    letters = n - sum(map(line.count, (b" ", b"\t"))) or 1
    size = len(words)
    alpha = len(line.translate(None, NOT_LETTERS))
    shares = (
        1.0,
        min(1.0, 5 * (n - len(line.translate(None, SYMBOLS))) / letters),
        min(1.0, 5 * line.count(b"!") / letters),
        min(1.0, 2 * words.count(b"|") / size),
        (n - len(line.translate(None, ASCII_UPPER))) / (alpha or 1),
        (n - len(line.translate(None, DIGITS))) / letters,
        alpha / letters,
        1.0 if size < 4 else 0.0,
        1.0 if seen else 0.0,
        sum(map(bytes.__eq__, words[1:], words)) / size,
        min(1.0, math.log1p(size) / 6),
    )
    weight = 0.5 + math.log1p(size) / 3
    return tuple([weight * x for x in shares])


@dataclass(frozen=True)
class LineCrf:
    """Two labels, 0 boilerplate and 1 content.  A path scores the weights of content over the features of
    its content lines plus the transitions between neighbours; boilerplate's weights are 0."""

    weights: tuple[float, ...]
    transitions: tuple[tuple[float, float], tuple[float, float]]

    def viterbi(self, rows: list[tuple[float, ...]]) -> list[int]:
        """The best labelling; content where two are equal."""
        if not rows:
            return []
        w, ((t00, t01), (t10, t11)) = self.weights, self.transitions
        back: list[tuple[int, int]] = []
        s0, s1 = 0.0, sum(map(float.__mul__, w, rows[0]))
        for x in rows[1:]:
            e = sum(map(float.__mul__, w, x))
            b0, v0 = (1, s1 + t10) if s1 + t10 >= s0 + t00 else (0, s0 + t00)
            b1, v1 = (1, s1 + t11) if s1 + t11 >= s0 + t01 else (0, s0 + t01)
            back.append((b0, b1))
            s0, s1 = v0, v1 + e
        path = [1 if s1 >= s0 else 0]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]


#: What judges where there are no labels, and only there: hand-set, symbols, shouting, bars and stuttering
#: against content.
PRIOR = LineCrf((2.0, -6.0, -6.0, -6.0, -4.0, -3.0, 1.0, -0.5, -1.0, -6.0, 0.5), ((0.5, -0.5), (-0.5, 0.5)))


def fit_crf(docs: list[np.ndarray], labels: list[int], steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> LineCrf:
    """Largest posterior under a Gaussian around zero, by gradient ascent with per-weight steps; forward-backward
    runs over all documents at once.  Features are divided by their root mean square over the training lines, so
    the ridge weighs on all alike; the weights returned are for features as they are.

    ``docs``: (lines, features); every line of a document has the document's label.  A document has the same
    weight whatever its lines, and both labels weigh the same in all."""
    docs, labels = zip(*[(d, y) for d, y in zip(docs, labels, strict=True) if len(d)], strict=True)
    n, long, k = len(docs), max(map(len, docs)), len(FEATURES)
    x, mask = np.zeros((long, n, k)), np.zeros((long, n), bool)
    for i, d in enumerate(docs):
        x[: len(d), i], mask[: len(d), i] = d, True
    lines = mask.sum(axis=0)
    scale = np.sqrt((x * x).sum((0, 1)) / lines.sum())
    scale[scale == 0] = 1.0
    x /= scale
    y = np.array(labels)
    share = np.array([(y == 0).sum(), (y == 1).sum()])[y]
    weight = 1.0 / (2 * share * lines)  # of each line of a document
    inside = mask[1:] * weight
    every = mask * weight
    seen_t = np.diag([inside[:, y == 0].sum(), inside[:, y == 1].sum()])
    seen_w = (x[:, y == 1] * every[:, y == 1, None]).sum((0, 1))
    w, t = np.zeros(k), np.zeros((2, 2))
    mean, square = np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, steps + 1):
        emit = np.stack([np.zeros((long, n)), x @ w], axis=-1)
        fore, aft = np.zeros((long, n, 2)), np.zeros((long, n, 2))
        fore[0] = emit[0]
        for i in range(1, long):
            go = np.logaddexp(fore[i - 1, :, 0, None] + t[0], fore[i - 1, :, 1, None] + t[1]) + emit[i]
            fore[i] = np.where(mask[i][:, None], go, fore[i - 1])
        z = np.logaddexp(fore[-1, :, 0], fore[-1, :, 1])
        for i in range(long - 2, -1, -1):
            to = emit[i + 1] + aft[i + 1]
            go = np.logaddexp(t[:, 0] + to[:, 0, None], t[:, 1] + to[:, 1, None])
            aft[i] = np.where(mask[i + 1][:, None], go, 0.0)
        content = np.exp(np.minimum(0.0, fore[..., 1] + aft[..., 1] - z)) * every
        pair = np.exp(np.minimum(0.0, fore[:-1, :, :, None] + t + (emit[1:] + aft[1:])[:, :, None, :] - z[:, None, None])) * inside[..., None, None]
        gw = seen_w - (x * content[..., None]).sum((0, 1)) - ridge * w
        gt = seen_t - pair.sum((0, 1)) - ridge * t
        g = np.concatenate([gw, gt.ravel()])
        mean += 0.1 * (g - mean)
        square += 0.01 * (g * g - square)
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w, t = w + move[:k], t + move[k:].reshape(2, 2)
    return LineCrf(tuple(map(float, w / scale)), tuple(tuple(map(float, r)) for r in t))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in some three-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    v = len(ids)
    if v < 2_000_000:
        code = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        code = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)[1] * v + a[2:]
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def parse_lines(data: bytes) -> tuple[list[tuple[float, ...]], list[int], int]:
    """(features, words) of the lines with a word, and how many equal an earlier line."""
    rows, sizes, seen, twice = [], [], set(), 0
    for line in data.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            twice += again
            seen.add(line)
            rows.append(line_features(line, words, again))
            sizes.append(len(words))
    return rows, sizes, twice


def judge(text: str | None, crf: LineCrf) -> tuple[int, int, int, int, int, bool, bool, float]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    rows, sizes, dup_lines = parse_lines(data)
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    share = sum(s for s, y in zip(sizes, crf.viterbi(rows), strict=True) if y) / n if n else 0.0
    return n, word_chars, symbols, dup_lines, repeats, failed, not failed and share >= LEAST_CONTENT, share


VERDICT = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "content_share": pa.float64(),
}
VERDICT_DDL = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double"


def train_line_crf(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> LineCrf:
    """The CRF of ``labels`` (doc_id, quality 0/1) over ``docs`` (doc_id, text), the lines of a document
    taking its label.  At most ``max_docs`` labelled documents train, those of least md5(doc_id), each of at
    most ``max_chars`` characters and TRAIN_LINES lines with a word.  Where either label is missing the answer
    is PRIOR.  Null texts don't train; rows of one doc_id train each, with the least of its labels."""
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    few = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(max_docs)
    rows = docs.where(F.char_length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "quality").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    if len({r["quality"] for r in rows}) < 2:
        return PRIOR
    x = [np.array(parse_lines(r["text"].encode())[0]) for r in rows]
    some = [(d, r["quality"]) for d, r in zip(x, rows, strict=True) if 0 < len(d) <= TRAIN_LINES]
    return fit_crf(*map(list, zip(*some, strict=True))) if len({y for _, y in some}) == 2 else PRIOR


def quality_rules(docs: DataFrame, crf: LineCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) of
    every whole text.

    One pass, no shuffle.  Null text counts as empty: no words, base_failed.  Repeated rows repeat, empty
    input gives empty output, other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [judge(t.as_py(), crf) for t in b.column(1)]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(VERDICT.values())]
            yield pa.record_batch([b.column(0), *cols], names=[id_col, *VERDICT])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {VERDICT_DDL}")


def keep_good(docs: DataFrame, crf: LineCrf, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns.  A null or empty text isn't kept;
    repeated rows are judged alike and stay repeated; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([judge(t.as_py(), crf)[6] for t in b.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
