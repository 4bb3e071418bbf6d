import re
from collections import Counter

from weft.llm.quality import PRIOR, LineCrf, fit_crf, judge, keep_good, parse_lines, quality_rules, train_line_crf
from weft.session import table

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), twice, len(covered), n < 50 or 100 * len(covered) > 50 * n


def best_path(crf: LineCrf, rows):
    """All labellings, the best of them."""
    import itertools

    def score(y):
        s = sum(sum(map(float.__mul__, crf.weights, x)) for x, v in zip(rows, y) if v)
        return s + sum(crf.transitions[a][b] for a, b in zip(y, y[1:]))

    return max(itertools.product((0, 1), repeat=len(rows)), key=score)


def test_base_columns(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in quality_rules(docs, PRIOR).collect()}
    for r in docs.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == brute(r["text"])
        assert not (g["base_failed"] and g["kept"])


def test_odd_rows(spark, odd_docs, no_docs, no_labels):
    from tests.llm.conftest import odd_rows

    got = quality_rules(odd_docs, PRIOR).collect()
    want = sorted(brute(r[1]) for r in odd_rows())
    assert sorted(tuple(r)[1:7] for r in got) == want
    kept = keep_good(odd_docs, PRIOR)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r["kept"] for r in got)
    assert quality_rules(no_docs, PRIOR).count() == keep_good(no_docs, PRIOR).count() == 0
    assert train_line_crf(odd_docs, no_labels) == PRIOR == train_line_crf(no_docs, no_labels)


def test_viterbi_is_the_best_path():
    text = "A plain line of prose that says something.\nBUY!! NOW!! CHEAP!!\na | b | c | d\nAnother plain line of prose here.\nx"
    rows = parse_lines(text.encode())[0]
    assert tuple(PRIOR.viterbi(rows)) == best_path(PRIOR, rows)


def test_training_tells_junk_from_prose(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = docs.join(labels, "doc_id").orderBy("doc_id").collect()
    import numpy as np

    half = len(rows) // 2
    crf = fit_crf([np.array(parse_lines(r["text"].encode())[0]) for r in rows[:half]], [r["quality"] for r in rows[:half]])
    wrong = sum(judge(r["text"], crf)[6] != (r["quality"] == 1 and not judge(r["text"], crf)[5]) for r in rows[half:])
    assert wrong <= 0.02 * half


def test_labels_decide():
    """Junk of no kind that PRIOR knows, learned from labels; flipped labels flip the verdicts."""
    import random

    import numpy as np

    r = random.Random(3)
    plain = lambda: "\n".join(" ".join("".join(r.choices("aeioulmnrst", k=6)) for _ in range(12)) for _ in range(6))
    digits = lambda: "\n".join(" ".join(str(r.randrange(10**6)) for _ in range(12)) for _ in range(6))
    docs = [plain() for _ in range(60)] + [digits() for _ in range(60)]
    x = [np.array(parse_lines(d.encode())[0]) for d in docs]
    labels = [1] * 60 + [0] * 60
    crf, flipped = fit_crf(x, labels), fit_crf(x, [1 - y for y in labels])
    for text, good in [(plain(), True) for _ in range(20)] + [(digits(), False) for _ in range(20)]:
        assert judge(text, crf)[6] == good and judge(text, flipped)[6] != good


def test_learned_paths_are_best(spark):
    import random

    import numpy as np

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    crf = train_line_crf(docs, labels)
    assert crf != PRIOR
    r = random.Random(8)
    lines = [x for d in docs.select("text").limit(200).collect() for x in parse_lines((d["text"] or "").encode())[0]]
    for _ in range(200):
        rows = [r.choice(lines) for _ in range(r.randint(0, 8))]
        y = tuple(crf.viterbi(rows))
        score = lambda y: sum(float(np.dot(crf.weights, x)) for x, v in zip(rows, y) if v) + sum(crf.transitions[a][b] for a, b in zip(y, y[1:]))
        assert abs(score(y) - score(best_path(crf, rows))) < 1e-9
