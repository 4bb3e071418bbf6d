import hashlib
import re

from weft.llm.mixing import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(5, 2, 1), ratio=1.5, repeats=2):
    """(taken of each row, target of each source) by the definition, one copy after the other."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    budget = ratio * sum(size)
    target, free, left = {}, set(sources), budget
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if repeats * total[s] <= w[s] * share]
        if not over:
            target |= {s: w[s] * share for s in free}
            break
        for s in over:
            target[s] = float(repeats * total[s])
            left -= target[s]
            free.discard(s)
    copies = []
    for s in sources:
        order = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (hashlib.md5(f"mix:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][0] is not None, rows[i][0] or 0, size[i]))
        served = 0
        for k in range(repeats):
            for i in order:
                served += size[i]
                if size[i]:
                    copies.append((served / w[s], "~" if s is None else "=" + s, i))
    taken, upto = [0] * len(rows), 0
    for _, _, i in sorted(copies):
        upto += size[i]
        if upto > budget:
            break
        taken[i] += size[i]
    return size, taken, target


def check(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    got = mix_sources(df).collect()
    size, taken, target = brute(rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["taken"]) for r in got) == sorted((x[0] is not None, x[0] or 0, n, t) for x, n, t in zip(rows, size, taken))
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] <= 2 * r["size"]
    return got


def test_odd_rows(spark, odd_docs):
    from tests.llm.conftest import SCHEMA, odd_rows

    check(spark, odd_rows(), SCHEMA)
    assert mix_sources(odd_docs).count() == odd_docs.count()


def test_many(spark):
    rows = [(i, "w " * (i * 37 % 91), "en", None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}", 0) for i in range(2000)]
    got = check(spark, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    for taken, target in by.values():
        assert abs(taken - target) <= 2 * 91


def test_empty(no_docs):
    assert mix_sources(no_docs).count() == 0
