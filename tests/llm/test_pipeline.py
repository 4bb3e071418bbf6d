import corpus_pipeline
from weft.session import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    n = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        n.append(docs.count())
    assert n[0] > n[1] > n[2] == n[3] and n[4] == n[5]
    direct = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, direct.collect())) == sorted(map(str, docs.collect()))


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    """What each stage makes of nulls, empty and long texts, ties and repeated rows."""
    from collections import Counter

    from tokenizers import Tokenizer

    from weft.llm.bpe import default_path
    from weft.llm.secrets import redact, scan

    rows = [tuple(r) for r in odd_docs.select(*corpus_pipeline.COLUMNS).collect()]
    stages = dict(corpus_pipeline.STAGES)
    run = {name: [tuple(r) for r in stage(spark, odd_docs, SF).collect()] for name, stage in corpus_pipeline.STAGES[:4]}
    plain = {name: Counter(out) for name, out in run.items()}
    words = lambda t: len((t or "").encode().split())
    # Quality: whole rows, alike for equal texts, none of fewer than 50 words; the repeated prose stays, the long repeats go.
    assert not plain["quality"] - Counter(rows)
    assert {r[1] for r in run["quality"]} == {r[1] for r in rows if words(r[1]) >= 50 and r[1] in {x[1] for x in run["quality"]}}
    assert all(plain["quality"][r] == Counter(rows)[r] for r in run["quality"])
    # Near-duplicates: one row of the prose and its near copy, of the repeated one-word text none is dropped without a twin.
    texts = [r[1] for r in run["near_dedup"]]
    assert not plain["near_dedup"] - Counter(rows)
    assert sum("quick fox" in (t or "") for t in texts) == 1
    assert Counter(t for t in texts if not words(t)) == Counter(r[1] for r in rows if not words(r[1]))
    assert {r[1] for r in rows if 0 < words(r[1]) and "quick fox" not in r[1]} == {t for t in texts if words(t) and "quick fox" not in t}
    # Secrets: every row, clean texts as they are.
    want = Counter((r[0], redact(r[1], s), r[2], r[3], len(redact(r[1], s))) if r[1] and (s := scan(r[1])) else r for r in rows)
    assert plain["secrets"] == want
    # Mixing: rows of the table at most twice each, none without words, about half as many words again.
    assert not plain["mixing"] - Counter({r: 2 * n for r, n in Counter(rows).items()})
    taken, total = sum(words(r[1]) for r in run["mixing"]), sum(words(r[1]) for r in rows)
    assert all(words(r[1]) for r in run["mixing"]) and taken <= 1.5 * total
    # Tokens: those of the library for each row.
    library = Tokenizer.from_file(default_path())
    coded = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((i, tuple(ids)) for i, n, ids in ((x[0], x[1], x[2]) for x in map(tuple, stages["bpe"](spark, odd_docs, SF).select("doc_id", "n_tokens", "ids").collect())) if n == len(ids)) == coded
    for name, stage in stages.items():
        out = stage(spark, no_docs, SF)
        assert out.count() == 0
        assert out.columns == (["doc_id", "n_tokens", "ids"] if name == "bpe" else list(corpus_pipeline.COLUMNS))


def test_near_copies_from_eighty_percent_go(spark):
    words = [f"w{i}" for i in range(304)]
    near = list(words)
    for i in range(10, 70, 10):
        near[i] = "other"
    far = list(words)
    for i in range(10, 190, 10):
        far[i] = "other"
    # 30 of 300 shingles differ: 270 / 330 = 0.82; 90 of them: 210 / 390
    rows = [(i, " ".join(t), "en", "web", 1) for i, t in enumerate([words, near, far])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [0, 2]


def words(seed, n=60):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_rows_not_ids_are_deduplicated(spark):
    one, two, three, four = (words(k) for k in range(4))
    rows = [
        (1, one, "en", "web", 1), (1, one, "en", "web", 1), (1, one, "en", None, 1), (1, one, None, "en", 1),  # copies under one id
        (2, two, "en", "web", 1), (3, two + " end", "en", "web", 1), (3, three, "en", "web", 1),  # an id on two texts
        (None, four, "en", "web", 1), (None, four, "en", "web", 1), (None, four + " end", "en", "web", 1), (None, two, "en", "web", 1), (None, words(9), "en", "web", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    texts = [t.removesuffix(" end") for _, t in got]
    assert sorted(texts) == sorted([one, two, three, four, words(9)])
    assert {t: i for i, t in got if i is not None} == {one: 1, two: 2, three: 3}


def test_mix_counts_rows(spark):
    rows = [(7, words(0), "en", "web", 1)] * 3 + [(None, words(k), "en", "web", 1) for k in range(1, 6)] + [(7, words(6), "en", "web", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = [r["text"] for r in corpus_pipeline.mixing(spark, docs, SF).collect()]
    # nine rows of 60 words, a budget of 1.5 times that: 13 whole rows, each at most twice
    assert len(got) == 13
    assert all(got.count(t) <= (6 if t == words(0) else 2) for t in got)


def test_what_a_worker_keeps_between_stages_is_bounded():
    """A worker lives through all stages, so tables of words and freed memory of one stay beside the next."""
    import tracemalloc

    from weft.llm import bpe, minhash

    code = bpe.Codec(bpe.default_path())
    minhash._words.clear()
    tracemalloc.start()
    try:
        for i in range(0, 300_000, 1000):
            text = " ".join(f"w{i + j}" for j in range(1000))
            minhash.shingle_set(text + " " + "x" * 100_000 + str(i))
            if i < 150_000:
                code.words([b"%dw" % (i + j) for j in range(1000)])
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
        minhash._words.clear()
    assert kept < 30e6
