import numpy as np
from pyspark.sql import functions as F

from weft.llm.urls import FEATURES, RULES, features, judge_urls, rule_labels, sample_labelled, split_url, train_url_model, with_parts
from weft.session import table

SF = "/root/testdata/sf0.1"


def brute_parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def brute_rule(host, path):
    fit = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://net/", "http://net", "https://x.org/fr/1", "http://example.com/de/?q", "http://a.b://c/d", "http://xexample.net/en/", "ftp://É.net/é\nx?q", "http://h#f/x", "http://h?q/x"]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    model = train_url_model(rule_labels(table(spark, SF, "pages")), 500)
    got = judge_urls(df, model).select("_row.page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = brute_parts(URLS[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert judge_urls(df.limit(0), model).count() == 0


def test_held_out_hosts_and_same_scores(spark):
    """Three quarters of the hosts train, the others are judged."""
    rows = rule_labels(table(spark, SF, "pages").select("url"))
    train, test = rows.where("pmod(xxhash64(split_part(url, '/', 3)), 4) > 0"), rows.where("pmod(xxhash64(split_part(url, '/', 3)), 4) = 0")
    model = train_url_model(train)
    got = features(with_parts(test), model.suffixes, model.segments).withColumn("score", model.score()).select("_x", "score", F.col("_row.label").alias("y")).collect()
    score = np.array([r["score"] for r in got])
    assert len(got) > 200 and {r["y"] for r in got} == {0, 1}
    assert np.allclose(score, model.score_rows(np.array([r["_x"] for r in got])))
    assert np.mean((score > 0) == np.array([r["y"] == 1 for r in got])) > 0.9


def brute_features(url, suffixes, segments):
    import math

    host, path = brute_parts(url)
    url = url or ""
    query = ""
    if "://" in url:
        rest = url.split("://", 1)[1].split("#")[0]
        query = rest.split("?", 1)[1] if "?" in rest else ""
    bits = lambda s: -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))
    digits = lambda s: sum("0" <= c <= "9" for c in s) / max(len(s), 1)
    rate, n = suffixes.get(host.split(".")[-1], (0.5, 0.0))
    return [len(url), path.count("/"), digits(url), bits(host), bits(path), query.count("&") + 1 if query else 0, len(query), len(host), host.count(".") + 1, host.count("-"), digits(host), rate, n, segments.get(path[1:].split("/")[0], (0.5, 0.0))[0]]


def test_features_against_brute_force(spark):
    urls = URLS + [r["url"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()] + ["http://a-b.c1.net/x/y//z.9?a=1&b=2&&c#d?e", "https://ÄÖ.org/ünï?q=日本", "http://x.y/" + "long/" * 20000]
    suffixes, segments = {"net": (0.75, 12.0), "org": (0.1, 3.0)}, {"en": (0.3, 9.0), "": (0.9, 1.0)}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = features(with_parts(df), suffixes, segments).select("_url", "_x").collect()
    assert len(got) == len(urls) and len(FEATURES) == 14
    for r in got:
        assert np.allclose(r["_x"], brute_features(r["_url"], suffixes, segments), atol=1e-9), r["_url"]


def test_sample_of_labels(spark):
    rows = [(f"http://h{i}.net/", i % 2) for i in range(50)] + [("http://hot.org/", 1)] * 300 + [("http://hot.org/", 0)] * 100 + [("http://n.com/", None), (None, 0)]
    df = spark.createDataFrame(rows, "url string, label int")
    got = {r["url"]: r["label"] for r in sample_labelled(df).collect()}
    assert len(got) == 52 and got["http://hot.org/"] == 0.75 and got[""] == 0
    assert [r["url"] for r in sample_labelled(df, 7).collect()] == [r["url"] for r in sample_labelled(df.repartition(5), 7).collect()]


def test_no_python_in_the_plan(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    out = judge_urls(pages.select("page_id", "url"), train_url_model(rule_labels(pages)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_no_training_rows(spark):
    model = train_url_model(spark.createDataFrame([], "url string, label int"))
    assert judge_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string"), model).first()["verdict"] == "allow"
    assert split_url(F.lit("x"))
