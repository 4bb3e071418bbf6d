import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from weft.llm.bpe import codec, default_path, encode_documents, tree_concat

rnd = random.Random(3)
ODD = ["", " ", "a", "ΑΣ ΣΑΣ", "İstanbul ½ ²", "<|endoftext|>", "x<|endoftext|>y  z", "e\u0301 a\u0300b", "\u00a0a\u3000b", "it's we'll I'VE", "日本語 中文", "\x1ca\x1db\x85c", "👍🏽👍 ok", "ﬁ ŉ ǆ", "q" * 60 + "<|endoftext|>" + "w" * 60]
ODD += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(40, 2000))) for _ in range(25)]
ODD += ["".join(rnd.choice(["th", "er", "ing", "a", "e", "ation", "pre", "zz"]) for _ in range(rnd.randint(40, 2000))) for _ in range(25)]
ODD += ["".join(rnd.choice("aeéö日<|>1!#") for _ in range(rnd.randint(40, 400))) for _ in range(25)]
ODD += ["a" * 3000, "ha" * 777, "!" * 500, "é" * 333]


def test_same_as_the_library(spark):
    library, c = Tokenizer.from_file(default_path()), codec(default_path())
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == ids, t[:80]
        assert c.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [1, 2, 5, 16])
def test_tree_of_any_leaf(leaf):
    c = codec(default_path())
    for t in ODD[15:40]:
        want = [x.id for x in c.tokenizer.model.tokenize(t)]
        assert tree_concat(t, c.leaves, c.length, leaf) == want
    assert tree_concat("", c.leaves, c.length) == []


def test_rows(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(default_path())
    got = encode_documents(odd_docs, decoded=True).collect()
    want = [library.encode(r["text"] or "", add_special_tokens=False).ids for r in odd_docs.select("text").collect()]
    assert sorted(list(r["ids"]) for r in got) == sorted(want)
    assert encode_documents(no_docs, decoded=True).count() == 0


def test_long_texts_go_through_the_tree(spark):
    """Whole documents of the fixture, and cuts at every kind of place."""
    import weft.llm.bpe as bpe

    library, c = Tokenizer.from_file(default_path()), codec(default_path())
    long = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("octet_length(text) > 8192").collect()]
    before = c.windows
    for t in long:
        assert c.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(long) > 20 and c.windows > len(long)
    before, kept = c.windows, bpe.LONG_TEXT
    texts = ODD + [" ".join(ODD), "a b " * 50, "\n\n".join(ODD[:12]) * 3, "x" * 500 + " " + "é日" * 300]
    try:
        for bpe.LONG_TEXT in (2, 6, 20, 100):
            for t in texts:
                assert c.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, (bpe.LONG_TEXT, t[:60])
    finally:
        bpe.LONG_TEXT = kept
    assert c.windows > before + 1000
