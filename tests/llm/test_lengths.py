from weft.llm.bpe import codec, default_path
from weft.llm.lengths import encoded_lengths, length_histogram, quantiles, truncated_totals
from weft.session import table


def check(lengths, rows):
    n, total = len(lengths), sum(lengths)
    assert sorted({*lengths}) == sorted(r["length"] for r in rows)
    for r in rows:
        x = r["length"]
        at = [v for v in lengths if v == x]
        up = [v for v in lengths if v >= x]
        cut = sum(min(v, x) for v in lengths)
        assert (r["n_docs"], r["n_tokens"], r["docs_upto"], r["docs_from"], r["tokens_from"], r["truncated_total"], r["lost_tokens"]) == (len(at), sum(at), n - len(up) + len(at), len(up), sum(up), cut, total - cut)


def test_histogram(spark):
    lengths = [0, 0, 3, 3, 3, 5, 4095, 4096, 4097, 9000, 9000, 20000]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lengths)] + [(99, None)], "doc_id bigint, n_tokens bigint")
    lengths = [*lengths, 0]
    hist = length_histogram(df).cache()
    check(lengths, hist.collect())
    limits = [0, 1, 4, 4096, 10**6]
    assert {r["limit"]: r["total"] for r in truncated_totals(hist, limits).collect()} == {m: sum(min(v, m) for v in lengths) for m in limits}
    s = sorted(lengths)
    assert {r["share"]: r["length"] for r in quantiles(hist, [0.0, 0.5, 1.0]).collect()} == {0.0: s[0], 0.5: s[6], 1.0: s[-1]}


def test_documents(spark, odd_docs, no_docs):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    c = codec(default_path())
    check([len(c.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()], length_histogram(encoded_lengths(docs)).collect())
    assert length_histogram(encoded_lengths(no_docs)).count() == 0
    assert [r["total"] for r in truncated_totals(length_histogram(encoded_lengths(no_docs)), [5]).collect()] == [0]
