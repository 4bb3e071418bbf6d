import random

import numpy as np

from weft.llm.minhash import HASHES, WIDE, band_keys, band_rows, least_estimate, minima, near_duplicates, packed, shingle_set


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            n = len(x & y)
            if n and 100 * n >= percent * (len(x) + len(y) - n):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i, _ in rows)


def corpus(n=120, seed=0):
    """Exact copies, chains of edits, a large group of near copies around a text, and unrelated ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [word() for _ in range(r.randint(1, 200))]
        for _ in range(r.choice([0, 1, 2, 3, 5, 6, 8]) if i % 3 else 0):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    chain = [word() for _ in range(150)]
    for i in range(40):
        chain[3 * i] = word()
        rows.append((1000 + i, " ".join(chain).upper() if i % 2 else " ".join(chain)))
    return rows + [(2000, rows[1][1]), (2001, None), (2002, ""), (2003, "one two"), (2004, "One  TWO"), (2005, "a b c d e"), (2006, "a b c d e f")]


def test_same_as_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute(rows)
    assert sorted(map(tuple, near_duplicates(df).collect())) == want


def test_odd_rows(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    known = [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is not null").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute(known)
    assert near_duplicates(no_docs).count() == 0


def test_sketches_agree_as_often_as_sets():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1700], r.integers(0, 1 << 63, 300, dtype=np.uint64)])
    ma, mb = minima(np.unique(a)), minima(np.unique(b))
    j = 1700 / 2300
    assert abs((ma == mb).mean() - j) < 0.13
    x = packed(ma) ^ packed(mb)
    differ = int(np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum())
    assert abs(((1 - differ / HASHES) - 0.25) / 0.75 - j) < 0.16
    assert len(band_keys(ma)) == 25 and len(shingle_set("a b c d e a b c d e")) == 5


def between(n=40, seed=3):
    """Pairs of texts at similarities from 0.74 to 0.88, and groups whose members are that near their first only."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(n):
        base = [word() for _ in range(400)]
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 4):
            w = list(base)
            at = r.sample(range(4, 396, 5), 6 + r.randrange(7))
            for j in at:
                w[j] = word()
            rows.append((10 * i + k, " ".join(w)))
    return rows


def test_eighty_percent_same_as_all_pairs(spark):
    rows = [(5000 + i, t) for i, t in between()] + corpus(90, 5)[:-7]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute(rows, 80)
    assert want != brute(rows, 85)
    assert sorted(map(tuple, near_duplicates(df, percent=80).collect())) == want


def test_bounds_follow_the_percentage():
    for percent in (70, 80, 85, 90):
        rows = band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (HASHES // rows) <= 1e-6
        assert least_estimate(percent, HASHES) < least_estimate(percent, WIDE) < percent / 100 - 0.04
    assert (band_rows(85), band_rows(80)) == (5, 4)


def test_small_parts_same_as_all_pairs(spark, monkeypatch):
    """Buckets and leaders cut into parts of three."""
    import weft.llm.minhash as m

    monkeypatch.setattr(m, "MEETING_ROWS", 3)
    rows = corpus(90, 2) + [(7000 + i, t) for i, t in between(12, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(map(tuple, near_duplicates(df, percent=80).collect())) == brute(rows, 80)


def test_one_large_bucket(spark, monkeypatch):
    """1,600 texts that differ in one word from one of two texts, which are nearly alike but not linked."""
    import weft.llm.minhash as m

    monkeypatch.setattr(m, "MEETING_ROWS", 200)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    one = [word() for _ in range(100)]
    two = list(one)
    for k in (10, 40, 70):
        two[k] = word()
    rows = [(0, " ".join(one)), (1, " ".join(two))]
    for i in range(2, 1602):
        w = list(one if i % 2 == 0 else two)
        w[4 + 5 * (i // 2 % 19)] = word()
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert not (100 * len(shingles(rows[0][1]) & shingles(rows[1][1])) >= 85 * len(shingles(rows[0][1]) | shingles(rows[1][1])))
    got = near_duplicates(df).collect()
    assert len(got) == 1602
    crossing = {x["component_id"] for x in got}
    # Every text is linked with the one it was made from; the two groups meet only if some pair across links.
    by = {x["doc_id"]: x["component_id"] for x in got}
    assert all(by[i] == by[i % 2] for i in range(2, 1602)) and crossing <= {0, 1}
