import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.plans import pipeline
from weft.sources import files, graphs, records
from weft.streaming.judging import judge_stream

YAML = """
version: '1.0'
type: RECORD
summary: {num_of_records: 3}
records:
  c1:
    - {id: r1, cluster_id: c1, data: {bib1_title: T1, bib1_author: ''}}
    - {id: r2, cluster_id: c1, data: {bib1_title: T2}}
  empty: []
  c2:
    - {id: r3, data: {bib1_title: T3, bib1_author: [A, B]}}
    - notarecord
"""


def test_yaml_layouts(spark, tmp_path):
    p = tmp_path / "a.yml"
    p.write_text(YAML, encoding="utf-8")
    df = records.read_records(spark, str(p))
    assert [(r["record_id"], r["cluster_id"]) for r in df.orderBy("ord").collect()] == [("r1", "c1"), ("r2", "c1"), ("r3", "c2")]
    b = {r["record_id"]: (r["title"], r["author"]) for r in records.bibliographic(df).collect()}
    assert b == {"r1": ("T1", ""), "r2": ("T2", None), "r3": ("T3", "A, B")}
    assert {r["cluster_id"]: r["n"] for r in records.cluster_summary(df).collect()} == {"c1": 2, "c2": 1}
    q = tmp_path / "b.yml"
    q.write_text("type: X\nk1:\n  - {id: 1, cluster_id: k1, title: t}\n")
    assert records.read_records(spark, str(q)).count() == 0
    assert records.read_records(spark, str(q), tolerant=True).first()["data"] == {"title": "t"}
    q.write_text("- {id: 1, title: t}\n- {id: 1, title: u, cluster_id: z}\n")
    one = records.one_per_id(records.read_records(spark, str(q), tolerant=True)).first()
    assert (one["cluster_id"], one["data"]["title"]) == ("z", "t")
    q.write_text("{broken: [")
    assert records.read_records(spark, str(q), tolerant=True).count() == 0
    assert records.read_records(spark, str(tmp_path / "missing.yml")).count() == 0
    out = tmp_path / "s.yml"
    records.write_sample(df, str(out), records.load(str(p)))
    doc = records.load(str(out))
    assert doc["summary"]["num_of_pairs"] == {"c1": 2, "c2": 1} and doc["version"] == "1.0"
    assert records.read_records(spark, str(out)).count() == 3


def test_graph_files(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"a": ["b", "a", "c"], "b": ["a"], "d": []}))
    v, e = graphs.read_adjacency(spark, str(p))
    assert sorted(r["id"] for r in v.collect()) == ["a", "b", "c", "d"]
    assert sorted((r["src"], r["dst"], r["rank"]) for r in e.collect()) == [("a", "b", 1), ("a", "c", 3), ("b", "a", 1)]
    assert graphs.read_adjacency(spark, str(p), self_loops=True)[1].count() == 4
    assert sorted(map(tuple, graphs.read_pairs_of_graph(spark, str(p)).collect())) == [("a", "b"), ("a", "c")]
    q = tmp_path / "n.json"
    q.write_text(json.dumps({"nodes": [{"id": "a"}], "links": [{"source": "b", "target": "a"}, {"source": "a", "target": "a"}, {"source": "None", "target": "a"}]}))
    assert [tuple(r) for r in graphs.read_node_link(spark, str(q)).collect()] == [("b", "a")]
    assert [tuple(r) for r in graphs.read_pairs_of_graph(spark, str(q)).collect()] == [("a", "b")]
    q.write_text("[1, 2")
    assert graphs.read_pairs_of_graph(spark, str(q)).count() == 0
    edges = spark.createDataFrame([("a", "b")], "a string, b string")
    adj = graphs.symmetric_adjacency(edges, v)
    graphs.write_adjacency(adj, str(tmp_path / "out"))
    docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()]
    assert {k: x for d in docs for k, x in d.items()} == {"a": ["b"], "b": ["a"], "c": [], "d": []}
    v2, e2 = graphs.read_adjacency(spark, str(tmp_path / "out"))
    assert sorted(r["id"] for r in v2.collect()) == ["a", "b", "c", "d"]
    assert sorted((r["src"], r["dst"], r["rank"]) for r in e2.collect()) == [("a", "b", 1), ("b", "a", 1)]


def test_files(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("record_id_1,record_id_2,llm_similarity_score\nb,a,0.5\na,b,0.7\nc,d,\nc,e,bad\nc,f,None\n")
    assert sorted(map(tuple, files.read_scores(spark, str(p)).collect())) == [("a", "b", 0.7), ("c", "d", 0.0), ("c", "f", 0.0)]
    assert files.read_candidate_pairs(spark, str(p)).count() == 5
    with pytest.raises(ValueError):
        files.read_simulation(spark, str(p))
    p.write_text("record_id_1,record_id_2,simulated_human_judgement\na,b,True\n,b,true\nc,d,x\n")
    assert [tuple(r) for r in files.read_simulation(spark, str(p)).collect()] == [("a", "b", True)]
    p.write_text("record_id_1,record_id_2,ground_truth_similar,predicted_similar_before,score_before\na,b,TRUE,0,0.5\na,c,maybe,1,x\n")
    assert [tuple(r) for r in files.read_detailed_results(spark, str(p)).collect()] == [("a", "b", True, False, 0.5)]
    p.write_text("record_id_1,record_id_2,llm_similarity_score,same_cluster_ground_truth\na,b,N/A,True\na,c,bad,False\n")
    assert [tuple(r) for r in files.read_review_candidates(spark, str(p)).collect()] == [("a", "b", 0.0, True)]
    j = tmp_path / "p.json"
    j.write_text('[["a","b",1],["c","d",0],["x"]]')
    assert sorted(map(tuple, files.read_labelled_pairs(spark, str(j)).collect())) == [("a", "b", 1), ("c", "d", 0)]
    j.write_text('{"a_b_ft:m": {"is_similar": true, "score": 0.5}, "c_d_base": {"is_similar": false, "score": 0.1}}')
    assert files.read_cache(spark, str(j)).count() == 2 and files.read_cache(spark, str(j), "ft:").first()["score"] == 0.5
    np.save(tmp_path / "v.npy", np.ones(3, np.float32))
    assert files.read_vectors(spark, str(tmp_path / "v.npy"), ["a"]).first()["embedding"] == [1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "v.npy"), ["a", "b"])
    df = spark.createDataFrame([("a", "b", 1)], "a string, b string, label int")
    files.write_csv(df, str(tmp_path / "csv"), ("a",))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    files.write_csv(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    files.write_labelled_pairs(df, str(tmp_path / "lp"))
    assert [x for p in (tmp_path / "lp").glob("part-*") for x in json.loads(p.read_text())] == [["a", "b", 1]]
    assert [tuple(r) for r in files.read_labelled_pairs(spark, str(tmp_path / "lp")).collect()] == [("a", "b", 1)]


def test_stream_judges_each_pair_once(spark, tmp_path):
    src, asked = tmp_path / "in", tmp_path / "asked"
    schema = "a bigint, b bigint, prompt string"

    def judge(prompt, log=str(asked)):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return "はい"

    for k, rows in enumerate(([(1, 2, "p12"), (3, 4, "p34")], [(2, 1, "p12"), (5, 6, "p56")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = judge_stream(spark.readStream.schema(schema).parquet(str(src)), judge, str(tmp_path / "cache"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert sorted(asked.read_text().split()) == ["p12", "p34", "p56"]


def test_pipeline(spark):
    docs = [(i, f"{'red' if i % 3 == 0 else 'blue' if i % 3 == 1 else 'green'} book about thing number {i % 3} vol {i}", i % 3) for i in range(30)]
    rec = spark.createDataFrame(docs, "id bigint, text string, cluster int")
    out = pipeline.run(rec, k=3, epochs=3, outputs=8)
    assert out.embeddings.count() == 30 and out.candidates.count() >= 45
    assert out.recall["0"].first()["edge_recall"] > 0.1
    again = pipeline.run(rec.withColumn("cluster", F.col("cluster")), network=out.network, k=3)
    assert sorted(map(tuple, again.candidates.collect())) == sorted(map(tuple, out.candidates.collect()))


ODD_TEXTS = ['plain', 'comma, "quote"', "line\nend", "日本語", "", " ", "{[:]}", "back\\slash"]


def test_graphs_come_back(spark, tmp_path):
    """51 vertices and 100 arcs through the writer of many files and of one."""
    arcs = [(f"v{i}", f"v{(i * 7 + k) % 50}", k + 1) for i in range(50) for k in range(2)]
    edges = spark.createDataFrame(arcs, "src string, dst string, rank int").repartition(5)
    loose = spark.createDataFrame([("lonely \"one\"", [])], "src string, neighbors array<string>")
    adj = graphs.adjacency(edges).unionByName(loose)
    for files_ in (None, 1):
        path = str(tmp_path / f"g{files_}")
        graphs.write_adjacency(adj, path, files_)
        v, e = graphs.read_adjacency(spark, path, self_loops=True)
        assert v.count() == 51 and sorted(map(tuple, e.collect())) == sorted(arcs)
        want = {tuple(sorted((a, b))) for a, b, _ in arcs if a != b}
        assert set(map(tuple, graphs.read_pairs_of_graph(spark, path).collect())) == want
    none = graphs.adjacency(edges.limit(0))
    graphs.write_adjacency(none, str(tmp_path / "none"))
    assert [d.count() for d in graphs.read_adjacency(spark, str(tmp_path / "none"))] == [0, 0]
    for missing in (str(tmp_path / "nowhere"),):
        assert [d.count() for d in graphs.read_adjacency(spark, missing)] == [0, 0]
        assert graphs.read_pairs_of_graph(spark, missing).count() == graphs.read_node_link(spark, missing).count() == 0
    comp = spark.createDataFrame([(t, "x" if i % 2 else "y") for i, t in enumerate(ODD_TEXTS)], "id string, component string")
    details = spark.createDataFrame([(t, t + t) for t in ODD_TEXTS[:5]], "id string, details string")
    listing = graphs.cluster_listing(comp, "initial_knn_cluster_", details, first=1)
    graphs.write_clusters(listing, str(tmp_path / "c"))
    got = sorted(map(tuple, graphs.read_clusters(spark, str(tmp_path / "c")).collect()))
    name = {"x": "initial_knn_cluster_1", "y": "initial_knn_cluster_2"}
    assert got == sorted((name["x" if i % 2 else "y"], t, t + t if i < 5 else f"Details not found for {t}") for i, t in enumerate(ODD_TEXTS))
    assert graphs.read_clusters(spark, str(tmp_path / "nowhere")).count() == 0
    assert {r["name"] for r in graphs.cluster_listing(comp, "contracted_cluster_", first=1, node=True).collect()} == {"contracted_cluster_1_node_x", "contracted_cluster_2_node_y"}


def test_pairs_and_caches_come_back(spark, tmp_path):
    rows = [(a, b, i % 2) for i, (a, b) in enumerate((a, b) for a in ODD_TEXTS for b in ODD_TEXTS if a < b)]
    df = spark.createDataFrame(rows, "a string, b string, label int").repartition(4)
    for n in (None, 1):
        files.write_labelled_pairs(df, str(tmp_path / f"p{n}"), n)
        assert sorted(map(tuple, files.read_labelled_pairs(spark, str(tmp_path / f"p{n}")).collect())) == sorted(rows)
    files.write_labelled_pairs(df.limit(0), str(tmp_path / "p0"))
    (tmp_path / "broken.json").write_text('[["a","b",1')
    for path in ("p0", "nowhere", "broken.json"):
        assert files.read_labelled_pairs(spark, str(tmp_path / path)).count() == 0
    cache = [(f"{a}_{b}", bool(i % 2), i / 7) for i, (a, b, _) in enumerate(rows)]
    df = spark.createDataFrame(cache, "key string, is_similar boolean, score double")
    files.write_cache(df, str(tmp_path / "json"))
    files.append_cache(df.limit(10), str(tmp_path / "parquet"))
    files.append_cache(df.subtract(df.limit(10)), str(tmp_path / "parquet"))
    for path in ("json", "parquet"):
        got = files.read_cache(spark, str(tmp_path / path)).select("key", "is_similar", "score")
        assert sorted(map(tuple, got.collect())) == sorted(cache)
    (tmp_path / "broken.json").write_text('{"a_b": {"is_similar"')
    for path in ("nowhere", "broken.json"):
        assert files.read_cache(spark, str(tmp_path / path)).count() == 0
    assert files.read_cache(spark, str(tmp_path / "json"), "日本").count() == sum("日本" in k for k, _, _ in cache)


def test_vectors_come_back(spark, tmp_path):
    import pickle

    x = np.random.default_rng(1).normal(size=(1000, 7)).astype(np.float32)
    ids = [f"id{i}" for i in range(1000)]
    np.save(tmp_path / "v.npy", x)
    (tmp_path / "v.pkl").write_bytes(pickle.dumps(ids))
    want = {i: tuple(map(float, v)) for i, v in zip(ids, x)}
    for args in ((ids,), (str(tmp_path / "v.pkl"),)):
        df = files.read_vectors(spark, str(tmp_path / "v.npy"), *args, rows=64)
        assert {r["id"]: tuple(r["embedding"]) for r in df.collect()} == want
    assert files.write_vectors(df.repartition(3), str(tmp_path / "out")) == 1000
    back = files.read_vectors(spark, str(tmp_path / "out"))
    assert {r["id"]: tuple(r["embedding"]) for r in back.collect()} == want
    assert files.write_vectors(df.limit(0), str(tmp_path / "none")) == 0
    (tmp_path / "bad.pkl").write_bytes(pickle.dumps([np.float64(1.0)]))
    with pytest.raises(Exception, match="id list"):
        files.read_vectors(spark, str(tmp_path / "v.npy"), str(tmp_path / "bad.pkl")).count()
    (tmp_path / "w.vec").write_text("3 2\na 3 4\nb 0 2\nb 9 9 x\nzero 0 0\n", encoding="utf-8")
    from weft.operators.ml import sentence_vectors

    words = files.read_word_vectors(spark, str(tmp_path / "w.vec"))
    assert words.count() == 3
    texts = spark.createDataFrame([(1, "a b a"), (2, "unknown"), (3, None), (4, ""), (5, " b  zero ")], "id bigint, text string")
    got = {r["id"]: [round(v, 6) for v in r["embedding"]] for r in sentence_vectors(texts, words).collect()}
    assert got == {1: [0.4, round((0.8 + 0.8 + 1) / 3, 6)], 5: [0.0, 0.5]}


def test_result_files_come_back(spark, tmp_path):
    from weft.operators import judging, review
    from weft.sources import layouts

    pairs = [(a, b) for a in ODD_TEXTS[:5] for b in ODD_TEXTS[:5] if a < b and a and b]
    gold = spark.createDataFrame([(a, b, [True, False, None][i % 3]) for i, (a, b) in enumerate(pairs)], "a string, b string, gold boolean")
    before = spark.createDataFrame([(a, b, bool(i % 2), i / 10, ["late, \"so\"", None][i % 2]) for i, (a, b) in enumerate(pairs)], "a string, b string, predicted boolean, score double, error string")
    after = before.where("score <> 0.3").withColumn("predicted", ~F.col("predicted"))
    files.write_csv(layouts.detailed(gold, before, after), str(tmp_path / "two"), ("record_id_1", "record_id_2"))
    files.write_csv(layouts.detailed(gold, before), str(tmp_path / "one"))
    got = {(r["a"], r["b"]): r for r in layouts.read_detailed(spark, str(tmp_path / "two")).collect()}
    one = {(r["a"], r["b"]): r for r in layouts.read_detailed(spark, str(tmp_path / "one")).collect()}
    assert len(got) == len(one) == len(pairs)
    for i, p in enumerate(pairs):
        first = ([True, False, None][i % 3], bool(i % 2), i / 10, ["late, \"so\"", None][i % 2])
        assert tuple(one[p])[2:] == first and tuple(got[p])[2:6] == first
        assert tuple(got[p])[6:] == ((None, None, None) if i == 3 else (not i % 2, *first[2:]))
    merged = {(r["a"], r["b"]): r for r in judging.compare_models(before, after).collect()}
    assert len(merged) == len(pairs) - 1 and all(r["error_before"] == r["error_after"] for r in merged.values())

    details = spark.createDataFrame([(t, f"text of {t}") for t in ODD_TEXTS[:4]], "id string, details string")
    asked = spark.createDataFrame([(a, b, f"{a}?{b}") for a, b in pairs], "a string, b string, prompt string")
    said = judging.explain_pairs(asked, lambda p: "はい\n類似度スコア: 0.95\n理由: " + p.replace("\n", "/"))
    table_ = layouts.results(said, details)
    assert table_.columns == list(layouts.RESULTS)
    files.write_csv(table_, str(tmp_path / "res"))
    back = {(r["a"], r["b"]): r for r in layouts.read_results(spark, str(tmp_path / "res")).collect()}
    assert set(back) == set(pairs) and all((r["judgement"], r["score"], r["status"]) == ("はい", 0.95, "ok") for r in back.values())
    assert all(back[a, b]["prompt"] == f"{a}?{b}" for a, b in pairs)

    edges = spark.createDataFrame([("r1", "r2", 0.9), ("r2", "r3", 0.9), ("r1", "r3", 0.1)], "a string, b string, score double")
    rec = spark.createDataFrame([("r1", "c1"), ("r2", "c1"), ("r3", None)], "id string, cluster string")
    top = review.top_triangles(edges, rec)
    t = layouts.triangles(top)
    assert t.columns == list(layouts.TRIANGLES) and (t.first()["true_edge12"], t.first()["true_edge23"], t.first()["cluster_id3"]) == ("True", None, None)
    rows = review.review_pairs(top, rec)
    files.write_csv(layouts.review(rows), str(tmp_path / "rev"), ("record_id_1", "record_id_2"))
    assert sorted(map(tuple, files.read_review_candidates(spark, str(tmp_path / "rev")).collect()), key=str) == [("r1", "r2", 0.9, True), ("r1", "r3", 0.1, None), ("r2", "r3", 0.9, None)]
    assert "N/A" in "".join(p.read_text() for p in (tmp_path / "rev").glob("part-*"))
    done = layouts.write_simulations({0.9: review.simulate_review(rows, 0.9), 1.0: review.simulate_review(rows, 1.0), 0.5: review.simulate_review(rows.limit(0), 0.5)}, str(tmp_path))
    assert [d.split("/")[-1] for d in done] == ["review_simulation_90.csv", "review_simulation_100.csv"]
    sim = layouts.read_simulation_file(spark, done[1])
    assert sorted(map(tuple, sim.collect()), key=str) == sorted(map(tuple, review.simulate_review(rows, 1.0).collect()), key=str)
    assert [tuple(r) for r in files.read_simulation(spark, done[1]).collect()] == [("r1", "r2", True)]


def test_reports(spark, tmp_path):
    from weft.operators import analysis, metrics
    from weft.sources import layouts

    flags = spark.createDataFrame([(True, True), (True, False), (False, False)], "gold boolean, predicted boolean")
    text = layouts.performance_report("Judged pairs", {"pairs": 3}, {"base:model": {"Pairs": metrics.label_confusion(flags, F.col("gold"), F.col("predicted"))}}, "2020-01-01")
    assert "| actual positive | TP 1 | FN 1 |" in text and "- recall: 0.5000" in text and "- pairs: 3" in text
    layouts.write_text(text, str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text() == text
    bins = analysis.score_bins(spark.createDataFrame([(0.05, True), (0.95, False)], "score double, gold boolean"))
    lines = layouts.markdown(bins, ("bin",)).split("\n")
    assert len(lines) == 13 and lines[2].split("|")[2].strip() == "1" and len(set(map(len, lines))) == 1
