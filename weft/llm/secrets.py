"""Secret scans with multipart credential linking: weak parts count only next to what completes them."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import slices

#: Kinds in the order in which spans of one start are listed; the first three are found on their own.
KINDS = ("assign", "access", "hex", "weak", "identifier", "endpoint")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

#: Where a key's name begins: names may have prefixes, as in DB_PASS.
BEGINS = r"(?<![A-Za-z0-9])"
WEAK = re.compile(BEGINS + r"""(?:pwd|pass|passphrase|passcode|auth|credentials?|private_?key|signature)["']?\x20*[:=]\x20*["']?([^\s"',;]{4,})""", re.IGNORECASE | re.ASCII)
BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
IDENTIFIER = re.compile(BEGINS + r"""(?:user|user_?name|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([^\s"',;]{2,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?<![A-Za-z0-9])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::\d+)?|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b""", re.IGNORECASE | re.ASCII)
BREAK = re.compile(r"\n[ \t\r]*\n")

#: Code points between the ends of two parts that can belong together.
WINDOW = 400

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Assignments, access identifiers and long hex runs, leftmost and non-overlapping per kind, by start."""
    found: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _bits(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _random_looking(token: str) -> bool:
    kinds = any(c.islower() for c in token) + any(c.isupper() for c in token) + any(c.isdigit() for c in token)
    return kinds == 3 and _bits(token) >= 3.5


class _Near:
    """Intervals by scope; answers whether one lies within the window of another."""

    def __init__(self, spans: list[Span], breaks: list[int]):
        self.breaks, self.by = breaks, {}
        for start, _, end in sorted(spans):
            starts, reach = self.by.setdefault(bisect_right(breaks, start), ([], []))
            starts.append(start)
            reach.append(max(end, reach[-1]) if reach else end)

    def any(self, span: Span, window: int) -> bool:
        start, _, end = span
        starts, reach = self.by.get(bisect_right(self.breaks, start), ([], []))
        k = bisect_left(starts, start)
        return bool(k and reach[k - 1] >= start - window) or bool(k < len(starts) and starts[k] <= end + window)


def linked_spans(text: str, base: list[Span], window: int = WINDOW) -> list[Span]:
    """Weak parts that are completed by others.

    An interval join in scopes (a scope is a paragraph, or what blank lines separate; parts join if they
    are in one scope with at most ``window`` code points between them): a weak secret is reported if an
    identifier, access key or endpoint joins it; an identifier or endpoint, if a base secret or a reported
    weak one joins it.  The join is a search in sorted intervals: no list of pairs is made.  Parts inside
    a base span are part of it.
    """
    weak = [(m.start(), 3, m.end()) for m in WEAK.finditer(text)] if ("=" in text or ":" in text) else []
    weak += [(m.start(), 3, m.end()) for m in BARE.finditer(text) if _random_looking(m[0])]
    if not weak and not base:
        return []
    ids = [(m.start(), 4, m.end()) for m in IDENTIFIER.finditer(text)]
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    starts, reach = [s for s, _, _ in base], []
    for _, _, e in base:
        reach.append(max(e, reach[-1]) if reach else e)

    def apart(spans: list[Span]) -> list[Span]:
        out, last = [], -1
        for s in sorted(spans):
            k = bisect_left(starts, s[2])
            if s[0] >= last and not (k and reach[k - 1] > s[0]):
                out.append(s)
                last = s[2]
        return out

    weak, ids, ends = apart(weak), apart(ids), apart(ends)
    if not (ids or ends or any(k == 1 for _, k, _ in base)):
        return []
    breaks = [m.start() for m in BREAK.finditer(text)]
    completing = _Near(ids + ends + [s for s in base if s[1] == 1], breaks)
    weak = [s for s in weak if completing.any(s, window)]
    secret = _Near([*base, *weak], breaks)
    return weak + [s for s in ids + ends if secret.any(s, window)]


def scan(text: str | None) -> list[Span]:
    """All spans of a text by start, kind and end; none for a null text."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked_spans(text, base))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): the secrets of every whole text as an array of (kind, start, end) in code points, end
    exclusive, by start, then kind in the order of KINDS.  One pass without shuffle, a text at a time; a null
    or empty text has no span.  Repeated rows give repeated rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t.as_py())] for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(spans, SPANS)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs``, same columns and rows, with secrets out of the text and the length set anew.  Null texts stay
    null, texts without a secret and their lengths stay as they are; repeated rows repeat; an empty table gives
    none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t.as_py() for t in b.column(text_col)]
            clean = [redact(t, spans) if t and (spans := scan(t)) else t for t in texts]
            new = {text_col: pa.array(clean, pa.string())}
            if chars_col in b.schema.names:
                old = b.column(chars_col)
                new[chars_col] = pa.array([o.as_py() if c is t else len(c) for c, t, o in zip(clean, texts, old, strict=True)], old.type)
            yield pa.record_batch([new.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
