import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions.judgement import parse_judgement, parse_verdict
from weft.functions.scalars import inconsistency
from weft.functions.text import record_text, text_representation
from weft.operators import analysis, blocking, contraction, graph, judging, metrics, ml, pairs, review
from weft.operators.knn import knn, undirected


def brute_components(nodes, edges):
    up = {v: v for v in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {v: root(v) for v in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "clique", "empty"])
def test_components(spark, kind):
    r = random.Random(4)
    n = 60
    edges = {
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(0, i) for i in range(1, n)],
        "random": [(r.randrange(n), r.randrange(n)) for _ in range(40)],
        "clique": [(i, j) for i in range(12) for j in range(12)],
        "empty": [],
    }[kind]
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    v = spark.range(n).select("id")
    got = {x["id"]: x["component"] for x in graph.connected_components(e, v).collect()}
    assert got == brute_components(range(n), edges)


def vectors(spark, n, dim=6, groups=3, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).round(2)
    if n > 4:
        x[3] = x[1]
    return x, spark.createDataFrame([(i, [float(t) for t in v], i % groups) for i, v in enumerate(x)], "id bigint, embedding array<double>, g int")


def brute_knn(x, k, group=None):
    out = []
    for i in range(len(x)):
        d = sorted((float(((x[j] - x[i]) ** 2).sum()), j) for j in range(len(x)) if j != i and (group is None or group[i] != group[j]))
        out += [(i, j, rank + 1) for rank, (_, j) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (5, 10), (50, 4)])
def test_knn_both_ways(spark, n, k):
    x, df = vectors(spark, n)
    want = brute_knn(x, min(k, max(n - 1, 0)))
    for args in ({}, {"broadcast_bytes": 0, "block_rows": 7}):
        assert sorted((r["src"], r["dst"], r["rank"]) for r in knn(df, k, **args).collect()) == want
    if n == 50:
        want = brute_knn(x, k, [i % 3 for i in range(n)])
        for args in ({}, {"broadcast_bytes": 0, "block_rows": 7}):
            assert sorted((r["src"], r["dst"], r["rank"]) for r in knn(df, k, group_col="g", **args).collect()) == want


def test_knn_string_ids_and_missing_vectors(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [5.0, 0.0]), ("d", None)], "id string, embedding array<double>")
    got = {(r["src"], r["dst"]) for r in knn(df, 1).collect()}
    assert got == {("a", "b"), ("b", "a"), ("c", "b")}
    assert undirected(knn(df, 1)).count() == 2


def test_contraction_is_components_of_true_edges(spark):
    r = random.Random(9)
    for _ in range(60):
        n = r.randint(2, 14)
        gold = [r.randrange(3) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 25))]
        nodes, found, _ = contraction.contract_steps(edges, lambda a, b: any(gold[x] == gold[y] for x in a for y in b))
        same = [(a, b) for a, b in edges if gold[a] == gold[b]]
        touched = {v for e in edges if e[0] != e[1] for v in e}
        want = brute_components(touched, [e for e in same if e[0] in touched])
        groups = {}
        for v, c in want.items():
            groups.setdefault(c, set()).add(v)
        assert sorted(map(sorted, nodes)) == sorted(map(sorted, groups.values()))
        assert found == {(a, b) for g in groups.values() for a in g for b in g if a < b}
    edges = [(0, 1), (1, 2), (2, 3), (3, 4)]
    rec = spark.createDataFrame([(i, "x" if i < 3 else "y") for i in range(6)], "id bigint, cluster string")
    got = {x["id"]: x["component"] for x in contraction.contract(spark.createDataFrame(edges, "a bigint, b bigint"), rec).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert contraction.contract_steps(edges, lambda a, b: True, 2)[2] == 2


def test_metrics_against_all_pairs(spark):
    r = random.Random(2)
    n = 40
    gold = [None if i % 11 == 0 else f"g{r.randrange(5)}" for i in range(n)]
    pred = [r.randrange(6) for _ in range(n)]
    rec = spark.createDataFrame([(i, g) for i, g in enumerate(gold)], "id bigint, cluster string")
    comp = spark.createDataFrame([(i, p) for i, p in enumerate(pred)], "id bigint, component bigint")
    t = metrics.contingency(comp, rec).cache()
    row = metrics.all_pairs_confusion(t).first()
    c = {"tp": 0, "fp": 0, "fn": 0, "tn": 0}
    for i in range(n):
        for j in range(i + 1, n):
            g, p = gold[i] is not None and gold[i] == gold[j], pred[i] == pred[j]
            c[("t" if g == p else "f") + ("p" if p else "n")] += 1
    assert {k: row[k] for k in c} == c
    one = metrics.cluster_scores(metrics.contingency(comp, rec.withColumn("cluster", (F.col("id") * 0).cast("string")))).first()
    assert one["homogeneity"] == 1.0
    same = metrics.contingency(comp, comp.select("id", F.col("component").alias("cluster")))
    assert all(abs(v - 1) < 1e-12 for v in metrics.cluster_scores(same).first())
    none = metrics.edge_quality(spark.createDataFrame([(1, 2)], "a bigint, b bigint"), rec.withColumn("cluster", F.lit(None).cast("string"))).first()
    assert (none["tp"], none["fp"], none["recall"], none["f1"]) == (0, 1, 0.0, 0.0)


def test_triangle_value_and_review(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.1)], "a bigint, b bigint, score double")
    assert abs(graph.triangles(e).select(inconsistency(F.col("p_uv"), F.col("p_vw"), F.col("p_wu")).alias("x")).first()["x"] - 0.747) < 1e-12
    rec = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id bigint, cluster string")
    top = review.top_triangles(e, rec)
    assert (top.first()["true_uv"], top.first()["true_vw"]) == (True, None)
    rows = review.review_pairs(top, rec)
    perfect = review.simulate_review(rows, 1.0)
    s = review.simulation_stats(perfect).first()
    assert (s["known"], s["human_right"]) == (1, 1)
    with pytest.raises(ValueError):
        review.simulate_review(rows, 1.5)


def test_text_edges(spark):
    rows = spark.createDataFrame([(None, None), ("", ""), ("  ", "b"), (" a ", None), ("a", "b")], "x string, y string")
    f = [F.col("x"), F.col("y")]
    got = [tuple(r) for r in rows.select(text_representation(f), record_text(f)).collect()]
    assert got == [("", None), ("", None), (" b", "b"), ("a", "a"), ("a b", "a b")]


def test_answers_that_are_odd(spark):
    texts = [None, "", "はい\n同じ本です\n確か", "いいえ。", "はいでもいいえ", "類似度スコア: 1.2.3\n類似度スコア: 0.4", "はい\n類似度スコア: 7"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r["p"]) for r in rows.select(parse_judgement(F.col("t")).alias("p")).collect()]
    assert got == [("不明", None, ""), ("不明", None, ""), ("はい", None, "同じ本です\n確か"), ("いいえ", None, ""), ("不明", None, ""), ("不明", 0.4, ""), ("はい", 7.0, "")]
    v = [(r["v"]["is_similar"], r["v"]["score"], r["v"]["error"] is None) for r in rows.select(parse_verdict(F.col("t")).alias("v")).collect()]
    assert v == [(None, None, False), (None, None, False), (True, 1.0, True), (False, 0.0, True), (True, 1.0, True), (None, None, False), (True, 7.0, True)]


def test_judging_with_cache_and_errors(spark):
    p = spark.createDataFrame([(1, 2, "はい"), (2, 1, "はい"), (3, 4, "boom"), (5, 6, "いいえ")], "a bigint, b bigint, prompt string")
    cache = spark.createDataFrame([("5_6", True, 0.9)], "key string, is_similar boolean, score double")

    def judge(prompt):
        if prompt == "boom":
            raise RuntimeError("no")
        return prompt

    done, news = judging.judge_pairs(p, cache, judge, attempts=2)
    got = {(r["a"], r["b"]): (r["is_similar"], r["score"], r["error"]) for r in done.collect()}
    assert got == {(1, 2): (True, 1.0, None), (2, 1): (True, 1.0, None), (3, 4): (None, None, "RuntimeError: no"), (5, 6): (True, 0.9, None)}
    assert [r["key"] for r in news.collect()] == ["1_2"]
    assert {r["predicted"] for r in judging.predictions(done).where("a = 3").collect()} == {False}
    said = judging.explain_pairs(p, judge).collect()
    assert {(r["a"], r["status"]) for r in said} == {(1, "ok"), (2, "ok"), (3, "error"), (5, "ok")}


def test_sampling(spark):
    rec = spark.createDataFrame([(i, i % 4) for i in range(40)], "id bigint, cluster int")
    assert pairs.negative_sample(rec, 10**6).count() == 600
    assert pairs.negative_sample(rec, 0).count() == 0
    drawn = pairs.negative_sample(rec, 500, "s").collect()
    assert len({(r["a"], r["b"]) for r in drawn}) == len(drawn) == 500 and all(r["a"] < r["b"] and (r["a"] - r["b"]) % 4 for r in drawn)
    known = pairs.negative_sample(rec, 300)
    other = pairs.nonmatch_sample(rec, known, 50)
    assert other.count() == 50 and other.join(known, ["a", "b"]).count() == 0
    assert pairs.record_sample(rec, 100).count() == 40


def test_merge_needs_two_clusters(spark):
    _, df = vectors(spark, 6)
    one = df.withColumn("component", F.lit(0))
    assert blocking.closest_clusters(one).count() == 0
    assert {r["component"] for r in blocking.merge_closest(one).collect()} == {0}
    with pytest.raises(ValueError):
        blocking.closest_clusters(one, "other")
    assert blocking.bridges(one, 0.5).count() == 0


def test_bins_and_edges(spark):
    s = [0.0, 0.05, 0.1, 0.1000001, 0.5, 1.0, 1.1, -0.1, float("nan"), None]
    rows = spark.createDataFrame([(x, i % 2 == 0) for i, x in enumerate(s)], "score double, gold boolean")
    got = {r["bin"]: r["n_all"] for r in analysis.score_bins(rows).collect()}
    assert got == {"0.0-0.1": 3, "0.1-0.2": 1, "0.4-0.5": 1, "0.9-1.0": 1, "total": 6} | {f"{i / 10:.1f}-{(i + 1) / 10:.1f}": 0 for i in (2, 3, 5, 6, 7, 8)}
    flat = spark.createDataFrame([(0.5, True)] * 3, "score double, gold boolean")
    assert sum(r["n"] for r in analysis.histogram(flat).collect()) == 3
    assert analysis.histogram(flat.limit(0)).count() == 50


def test_network_learns():
    r = np.random.default_rng(0)
    centre = r.normal(size=(4, 20))
    label = r.integers(0, 4, 200)
    x = centre[label] + 0.3 * r.normal(size=(200, 20))
    a, b = r.integers(0, 200, 600), r.integers(0, 200, 600)
    y = (label[a] == label[b]).astype(float)
    net, losses = ml.train(x[a], x[b], y, ml.Network.fresh(20, 16, 8), epochs=8, rate=5e-3)
    assert losses[-1] < 0.5 * losses[0]
    d = np.linalg.norm(net.forward(x[a]) - net.forward(x[b]), axis=1)
    assert d[y == 1].mean() < d[y == 0].mean()


def test_embedding_batches_that_fail(spark):
    t = spark.createDataFrame([(i, "" if i == 3 else f"t{i}") for i in range(8)], "id bigint, text string").coalesce(1)

    def client(texts):
        if "t5" in texts:
            raise RuntimeError("down")
        return [[1.0, 2.0] for _ in texts]

    assert sorted(r["id"] for r in ml.embed(t, client, batch=1).collect()) == [0, 1, 2, 4, 6, 7]
    assert ml.embed(t).count() == 7


def brute_order(cluster, seed):
    """All cross pairs in the sample's order, by the rule as stated, one number at a time."""
    digest = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    at = sorted(cluster, key=lambda i: (digest(cluster[i])[:3], cluster[i], digest(i)[:3], i))
    numbers, s = [], 0
    while s < len(at):
        n = sum(cluster[i] == cluster[at[s]] for i in at)
        numbers += [(at[s + k // s], at[k % s]) for k in range(n * s)]
        s += n
    half = max(1, ((len(numbers) - 1).bit_length() + 1) // 2)
    out = []
    for t in range(4**half):
        left, right = t >> half, t & (2**half - 1)
        for i in range(1, pairs.ROUNDS + 1):
            left, right = right, left ^ (int(digest(f"{seed}:{i}:{right}")[:8], 16) & (2**half - 1))
        if (i := left << half | right) < len(numbers):
            out.append((min(numbers[i]), max(numbers[i])))
    return out


def test_negatives_have_one_order_at_every_size(spark):
    cluster = {i: 0 if i < 180 else i for i in range(200)}
    rec = spark.createDataFrame(list(cluster.items()), "id bigint, cluster bigint")
    order = brute_order(cluster, "neg")
    assert len(set(order)) == len(order) == 200 * 199 // 2 - 180 * 179 // 2
    for size in (1, 600, len(order) - 1, len(order) + 5):
        got = [(r["a"], r["b"]) for r in pairs.cross_sample(rec, size, "neg").orderBy("t").collect()]
        assert got == order[:size]
    order = brute_order(cluster, "non")
    known = spark.createDataFrame(order[:3000], "a bigint, b bigint")
    got = {(r["a"], r["b"]) for r in pairs.nonmatch_sample(rec, known, 20).collect()}
    assert got == set(order[3000:3020])


def test_negatives_beside_one_dominant_cluster(spark):
    rec = spark.range(1_000_000).select("id", F.when(F.col("id") < 60, 1).otherwise(0).alias("cluster"))
    rows = pairs.negative_sample(rec, 5000).collect()
    assert len({(r["a"], r["b"]) for r in rows}) == 5000 and all(r["a"] < 60 <= r["b"] for r in rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gold_pairs_are_made_in_blocks_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 8)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 500)
    cluster = {i: None if i % 11 == 0 else 1 if i < 70 else i % 6 for i in range(200)}
    rec = spark.createDataFrame([(i, c) for i, c in cluster.items()], "id bigint, cluster int")
    want = sorted((a, b) for a in cluster for b in cluster if a < b and cluster[a] is not None and cluster[a] == cluster[b])
    found = pairs.gold_pairs(rec)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == want
    assert found.rdd.getNumPartitions() > 4 and "HashAggregate" not in plan_of(found)
    # An id in two clusters, one of them with a record that is in both as well, and a row that repeats.
    rec = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1), (2, 1), (5, 1), (None, 1)], "id bigint, cluster int")
    got = [(r["a"], r["b"]) for r in pairs.gold_pairs(rec).collect()]
    odd = {*range(1, 40, 2), 0, 2}
    assert sorted(got) == sorted({(a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 == b % 2 == 0 or {a, b} <= odd})


def test_positive_pairs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_PAIRS", 100_000, raising=False)
    rec = spark.range(3000).select("id", F.lit("one").alias("cluster"))
    found = pairs.positive_pairs(rec)
    parts = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 3000 * 2999 // 2 and len(parts) > 4
    assert found.where("a >= b or label <> 1").isEmpty()


def test_positives_come_from_arrays_and_equal_those_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_PAIRS", 700)
    monkeypatch.setattr(pairs, "CHUNK", 64)
    for make in (F.col("id"), F.concat(F.lit("é"), F.col("id").cast("string"))):
        rec = spark.range(300).select(make.alias("id"), F.when(F.col("id") % 9 > 0, F.sqrt("id").cast("int")).alias("cluster"))
        rec = rec.unionByName(rec.where("cluster = 4")).unionByName(rec.limit(2).withColumn("cluster", F.lit(99)).withColumn("id", F.lit(None)))
        found = pairs.positive_pairs(rec)
        assert "Join" not in plan_of(found) and "Exchange" not in plan_of(found)
        got = sorted(map(tuple, found.collect()))
        of = {x["id"]: x["cluster"] for x in rec.collect() if x["cluster"] is not None and x["id"] is not None}
        assert got == sorted((a, b, 1) for a in of for b in of if a < b and of[a] == of[b])
        with monkeypatch.context() as m:
            m.setattr(pairs, "AT_HAND", 0)
            assert got == sorted(map(tuple, pairs.positive_pairs(rec).collect()))
    assert pairs.positive_pairs(rec.where("cluster is null")).count() == pairs.positive_pairs(rec.limit(1)).count() == 0


def test_negatives_come_from_arrays_and_equal_those_of_joins(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PART", 4096, raising=False)
    monkeypatch.setattr(pairs, "CHUNK", 1000, raising=False)
    for make in (F.col("id"), F.concat(F.lit("é"), F.col("id").cast("string"))):
        rec = spark.range(400).select(make.alias("id"), F.when(F.col("id") % 9 > 0, F.sqrt("id").cast("int")).alias("cluster"))
        for size in (1, 5000, 10**6):
            found = pairs.cross_sample(rec, size, "neg")
            assert "Join" not in plan_of(found)
            got = sorted(map(tuple, found.collect()))
            with monkeypatch.context() as m:
                m.setattr(pairs, "AT_HAND", 0)
                assert got == sorted(map(tuple, pairs.cross_sample(rec, size, "neg").collect())) and got
    assert pairs.cross_sample(rec, 0, "neg").count() == pairs.cross_sample(rec.where("cluster = 3"), 9, "neg").count() == 0


def test_loss_of_clusters_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 5).astype(np.float32)], None if i % 13 == 0 else i % 4) for i in range(150)]
    rec = spark.createDataFrame(rows, "id bigint, embedding array<float>, cluster int")
    labelled = pairs.positive_pairs(rec).unionByName(pairs.negative_sample(rec, 700))
    want = ml.contrastive_loss(labelled, rec).first()
    gaps = rec.withColumn("embedding", F.when(F.col("id") > 3, F.col("embedding")))
    known = ml.contrastive_loss(labelled.where("a > 3"), rec).first()
    repeated = rec.union(rec.where("id = 9"))
    slow = ml.contrastive_loss(pairs.positive_pairs(repeated).unionByName(pairs.negative_sample(repeated, 700)), repeated).first()
    got = ml.cluster_loss(repeated, 700).first()
    assert got["pairs"] == slow["pairs"] and abs(got["loss"] - slow["loss"]) < 1e-12
    for name in ("positive_pairs", "cross_sample"):
        monkeypatch.delattr(ml, name)
    got, some = ml.cluster_loss(rec, 700).first(), ml.cluster_loss(gaps, 700).first()
    assert got["pairs"] == want["pairs"] == some["pairs"] and abs(got["loss"] - want["loss"]) < 1e-12 and abs(some["loss"] - known["loss"]) < 1e-12
    none = ml.cluster_loss(rec.where("id = 1"), 5).first()
    assert none["pairs"] == 0 and none["loss"] is None


def test_set_sizes_make_no_gold_pairs(spark, monkeypatch):
    from weft.plans import catalog

    monkeypatch.delattr(pairs, "gold_pairs")
    row = catalog.pair_set_ops(spark, "/root/testdata/sf0.001").first()
    assert row["in_either"] == row["in_both"] + row["only_proposed"] + row["only_gold"] and row["only_gold"] > 0


def test_judges_that_hang_or_ask_to_wait(spark):
    import time

    p = spark.createDataFrame([(1, 2, "hang"), (3, 4, "wait"), (5, 6, "ok")], "a bigint, b bigint, prompt string").coalesce(1)

    def judge(prompt):
        if prompt == "hang":
            time.sleep(30)
        if prompt == "wait":
            raise judging.RateLimited("slow down")
        return "はい"

    began = time.time()
    rows = judging.ask(judging.with_key(p), judge, attempts=2, timeout=0.5, rate_wait=0.4, pace=0.1, concurrency=1).collect()
    assert time.time() - began < 20
    assert {r["key"]: (r["answer"], r["error"]) for r in rows} == {"1_2": (None, "TimeoutError: no answer in 0.5 s"), "3_4": (None, "RateLimited: slow down"), "5_6": ("はい", None)}
    assert [r["a"] for r in judging.first_pairs(p, 2).collect()] == [1, 3] and judging.first_pairs(p, 0).count() == 3


def test_hubs_make_no_squares(spark):
    """Triangles and common neighbours of random graphs and of a hub, against brute force."""
    r = random.Random(6)
    for edges in ([tuple(sorted(r.sample(range(25), 2))) for _ in range(120)], [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59, 2)], []):
        edges = sorted(set(edges))
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        score = {e: round(r.random(), 3) for e in edges}
        df = spark.createDataFrame([(a, b, score[a, b]) for a, b in edges], "a bigint, b bigint, score double")
        got = {tuple(x) for x in graph.triangles(df).collect()}
        assert got == {(u, v, w, score[u, v], score[v, w], score[u, w]) for u, v in edges for w in near[u] & near[v] if w > v}
        assert {tuple(x) for x in graph.common_neighbors(df).collect()} == {(a, b, len(near[a] & near[b])) for a, b in edges}


def test_close_and_nearest_by_blocks(spark):
    from weft.operators.knn import within

    x, df = vectors(spark, 60)
    for radius in (0.5, 1.5, 2.5):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= radius}
        for rows in (7, 1000):
            assert {tuple(r) for r in within(df, radius, block_rows=rows).collect()} == want
    assert within(df.limit(1), 1.0).count() == 0
    m = df.withColumn("component", F.col("g"))
    close = spark.createDataFrame([(0, 1), (0, 2)], "ca int, cb int")
    for rows in (4, 1000):
        for r in blocking.nearest_pairs(m, close, rows).collect():
            want = min((float(((x[j] - x[i]) ** 2).sum()), i, j) for i in range(60) for j in range(60) if i % 3 == r["ca"] and j % 3 == r["cb"])
            assert (r["a"], r["b"]) == want[1:] and abs(r["d2"] - want[0]) < 1e-9


def test_numbers_by_ranges(spark):
    from weft.session import numbered

    ids = random.Random(1).sample(range(10**6), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(7)
    assert {r["id"]: r["number"] for r in numbered(df, "id").collect()} == {v: k for k, v in enumerate(sorted(ids))}
    assert numbered(df.limit(0), "id").count() == 0
