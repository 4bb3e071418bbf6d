"""BPE encoding and decoding of whole texts, with tree concatenation for text that no rule splits."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from weft.session import slices

#: Pre-tokens of more symbols than this are encoded as a tree; leaves have at most this many.
LEAF = 48
#: Texts of more bytes than this are cut into halves down to pieces of at most half of it, wherever that falls.
LONG_TEXT = 8192
#: Words whose encoding a worker keeps, at about 500 bytes each; the table is emptied when it is full.
KEEP_WORDS = 1 << 16
#: Words of these characters need no normalising but lower case: no white space, no marks, stable classes.
PLAIN = regex.compile(r"[!-~¡-ɏ]+")
#: Fixed value: the split rule of the public word-level vocabulary.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, others follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


def tree_concat(symbols: str, encode_leaves: Callable[[list[str], list[bool]], list[list[int]]], lengths: Callable[[int], int], leaf: int = LEAF) -> list[int]:
    """The tokens of one unsplit run of symbols.

    The run is cut into halves down to leaves of at most ``leaf`` symbols; all leaves are encoded in one
    call (which may use many threads) and joined upwards.  At a join the last k tokens on the left and the
    first k on the right are encoded anew as one window, k doubling, until the window begins with the token
    that the left side has there and ends with the token that the right side has there.  A token sequence
    is the encoding of its text exactly if every two neighbours are the encoding of theirs, so what lies
    outside such a window stands.  ``encode_leaves`` takes texts and, for each, whether the run ends there.
    """
    n = len(symbols)
    if n == 0:
        return []
    pieces = 1
    while n > leaf * pieces:
        pieces *= 2
    cuts = [n * i // pieces for i in range(pieces + 1)]
    parts = encode_leaves([symbols[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], [b == n for b in cuts[1:]])
    level = list(zip(parts, cuts, cuts[1:], strict=False))
    while len(level) > 1:
        joined = []
        for (left, a, m), (right, _, b) in zip(level[::2], level[1::2], strict=True):
            k = 1
            while True:
                lk, rk = min(k, len(left)), min(k, len(right))
                start = m - sum(map(lengths, left[len(left) - lk :]))
                end = m + sum(map(lengths, right[:rk]))
                window = encode_leaves([symbols[start:end]], [end == n])[0]
                left_agrees = lk == len(left) or window[0] == left[-lk]
                right_agrees = rk == len(right) or window[-1] == right[rk - 1]
                if left_agrees and right_agrees:
                    break
                k *= 2
            joined.append((left[: len(left) - lk] + window + right[rk:], a, b))
        level = joined
    return level[0][0]


class Codec:
    """Encoder and decoder over a tokenizer file of byte-level symbols with a word-end suffix."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: The same merges for runs that don't end a word.
        self.open_model = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        self.closed_model = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix or None))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(True))]
        self.known: dict[bytes, bytes] = {}
        #: Windows encoded at joins so far.
        self.windows = 0

    def length(self, token: int) -> int:
        text = self.tokens[token]
        return len(text) - len(self.suffix) if self.suffix and text.endswith(self.suffix) else len(text)

    def leaves(self, texts: list[str], closed: list[bool]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for flag, model in ((False, self.open_model), (True, self.closed_model)):
            at = [i for i, c in enumerate(closed) if c is flag]
            for i, e in zip(at, model.encode_batch([texts[i] for i in at], add_special_tokens=False) if at else [], strict=True):
                out[i] = e.ids
        return out

    def pretoken(self, symbols: str) -> list[int]:
        if len(symbols) > LEAF:
            return tree_concat(symbols, self.leaves, self.length)
        return [t.id for t in self.tokenizer.model.tokenize(symbols)]

    def word(self, word: bytes) -> list[int]:
        """The ids of a text without ASCII white space."""
        text = word.decode("utf-8")
        if any(s in text for s in self.special):
            if len(text) > LEAF:
                parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
                return [i for p in parts if p for i in ([self.tokenizer.token_to_id(p)] if p in self.special else self.word(p.encode()))]
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if PLAIN.fullmatch(text):
            low = text.lower()
            if low.isascii():
                pieces = SPLIT.findall(low)
            else:
                table = byte_symbols()
                pieces = ["".join([table[b] for b in p.encode()]) for p in SPLIT.findall(low)]
        else:
            pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        return [i for p in pieces for i in self.pretoken(p)]

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of an int32 array.  ASCII white space always splits, so each
        distinct word is encoded once and looked up afterwards."""
        known, out = self.known, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.word(w), np.int32).tobytes()
                if len(known) >= KEEP_WORDS:
                    known.clear()
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return out

    def concat(self, data: bytes) -> list[bytes]:
        """The ids of a long text by tree concatenation.

        The text is cut into halves down to pieces of at most LONG_TEXT / 2 bytes, at any character; pieces are
        encoded on their own and joined upwards.  Where a cut parts a word, the last k words on the left and the
        first k on the right are encoded anew as one window of the text, k doubling, until the window's first word
        has the ids that the left side has there and its last word those that the right side has there.  Words
        don't depend on each other, so what lies outside such a window stands."""
        pieces = 1
        while len(data) > LONG_TEXT // 2 * pieces:
            pieces *= 2
        cuts = [len(data) * i // pieces for i in range(pieces + 1)]
        for i in range(1, pieces):
            while cuts[i] < len(data) and data[cuts[i]] & 0xC0 == 0x80:
                cuts[i] += 1
        split = [data[a:b].split() for a, b in zip(cuts, cuts[1:], strict=False)]
        level = [(w, self.words(w), m) for w, m in zip(split, cuts[1:], strict=True)]
        while len(level) > 1:
            above = []
            for (lw, li, m), (rw, ri, end) in zip(level[::2], level[1::2], strict=True):
                k = 1
                while lw and rw and m < len(data) and not data[m - 1 : m].isspace() and not data[m : m + 1].isspace():
                    lk, rk = min(k, len(lw)), min(k, len(rw))
                    window = [*lw[-lk:-1], lw[-1] + rw[0], *rw[1:rk]]
                    ids = self.words(window)
                    self.windows += 1
                    left_agrees = lk == len(lw) or ids[0] == li[-lk]
                    right_agrees = rk == len(rw) or ids[-1] == ri[rk - 1]
                    if left_agrees and right_agrees:
                        lw, li, rw, ri = lw[:-lk] + window, li[:-lk] + ids, rw[rk:], ri[rk:]
                        break
                    k *= 2
                above.append((lw + rw, li + ri, end))
            level = above
        return level[0][1]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text (none for null); long texts go through ``concat``."""
        data = (text or "").encode("utf-8")
        return np.frombuffer(b"".join(self.concat(data) if len(data) > LONG_TEXT else self.words(data.split())), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes without a decoder: tokens joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@cache
def codec(path: str) -> Codec:
    """A worker's codec; one per file and process."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) of every whole text, and with ``decoded`` what its ids decode to.

    One pass, no shuffle; rows keep their number, so repeated rows repeat.  Null and empty texts have no ids
    and decode to an empty text.  Texts of any length: memory grows with the longest text of a batch.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            ids = [c.encode(t.as_py()) for t in b.column(1)]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            cols = [b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
            if decoded:
                cols.append(pa.array([c.decode(x) for x in ids], pa.string()))
            yield pa.record_batch(cols, names=[id_col, "ids", "decoded"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decoded)
