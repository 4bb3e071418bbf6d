"""URL filtering: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features, rules and scores are DataFrame expressions; only a bounded labelled sample is collected, to grow
the trees on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) rules of the op3 query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

FEATURES = (
    "url_length", "path_depth", "digit_ratio", "host_entropy", "path_entropy", "n_params", "query_length",
    "host_length", "host_labels", "host_hyphens", "host_digit_ratio", "suffix_rate", "suffix_count", "segment_rate",
)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query): the host is what follows the first "://" up to "/", "?", "#" or the end, A-Z
    lower-cased; the path then goes up to "?", "#" or the end, the query from "?" to "#".  A null url or one
    without "://" has three empty strings."""
    at = F.instr(url, "://")
    after = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(after, r"\A[^/?#]*", 0)
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(after, r"\A[^?#]*\?([^#]*)", 1)
    return F.translate(host, UPPER, LOWER), path, query


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df``'s rows as (_row, _url, _host, _path, _query); _row is the whole row, so no name can clash."""
    base = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), df[f"`{url_col}`"].alias("_url"))
    host, path, query = split_url(F.col("_url"))
    return base.select("_row", "_url", host.alias("_host"), path.alias("_path"), query.alias("_query"))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; a rule fits its host and all subdomains
    if the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, r_host, r_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == r_host) | host.endswith(f".{r_host}")) & path.startswith(r_path)
        rule, verdict = F.when(fits, r_host + r_path).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def entropy(s: Column) -> Column:
    """Bits per character of a string; 0 if empty."""
    n = F.char_length(s).cast("double")
    chars = F.array_distinct(F.split(s, ""))
    share = lambda c: (n - F.char_length(F.replace(s, c, F.lit("")))) / n
    bits = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def segment_of(path: Column) -> Column:
    """The path's first segment."""
    return F.substring_index(F.substring(path, 2, 1 << 30), "/", 1)


def looked_up(key: Column, stats: dict[str, tuple[float, float]]) -> tuple[Column, Column]:
    """(rate, count) of a key: a half and 0 where it isn't known."""
    pairs = [F.lit(x) for k, (rate, n) in sorted(stats.items()) for x in (k, f"{rate}|{n}")]
    known = F.create_map(*pairs)[key] if pairs else F.lit(None).cast("string")
    both = F.split(F.coalesce(known, F.lit("0.5|0.0")), r"\|")
    return both[0], both[1]


def features(parts: DataFrame, suffixes: dict[str, tuple[float, float]], segments: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``parts`` with a column _x: the array of FEATURES.  ``suffixes`` and ``segments``: block rate and count of
    host suffixes and first path segments in the labelled sample."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    host, path, query = F.col("_host"), F.col("_path"), F.col("_query")
    digits = lambda s: F.char_length(F.regexp_replace(s, "[^0-9]", "")) / F.greatest(F.char_length(s), F.lit(1))
    count = lambda s, c: F.char_length(s) - F.char_length(F.replace(s, F.lit(c), F.lit("")))
    x = [
        F.char_length(url), count(path, "/"), digits(url), entropy(host), entropy(path),
        F.when(query != "", count(query, "&") + 1).otherwise(0), F.char_length(query),
        F.char_length(host), count(host, ".") + 1, count(host, "-"), digits(host), *looked_up(suffix_of(host), suffixes),
        looked_up(segment_of(path), segments or {})[0],
    ]
    return parts.withColumn("_x", F.array(*[c.cast("double") for c in x]))


@dataclass(frozen=True)
class UrlModel:
    """Boosted trees as (feature, threshold, left, right) tuples with float leaves, and the tables of suffixes
    and first segments."""

    base: float
    trees: tuple
    suffixes: dict[str, tuple[float, float]]
    segments: dict[str, tuple[float, float]]

    def score(self) -> Column:
        """Log-odds of "block" over the column _x."""

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            f, t, left, right = node
            return F.when(F.col("_x")[f] <= t, walk(left)).otherwise(walk(right))

        return sum((walk(t) for t in self.trees), F.lit(self.base))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        """The same on the driver, for tests."""

        def walk(node, row) -> float:
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([self.base + sum(walk(t, r) for t in self.trees) for r in x])


def grow_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> tuple[float, tuple]:
    """Boosted trees by second-order logistic loss over quantile histograms."""
    p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    score, trees = np.full(len(y), base), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        step = np.zeros(len(y))

        def grow(rows: np.ndarray, level: int, g=g, h=h, step=step):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level:
                for f, c in enumerate(cuts):
                    if len(c) == 0:
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (f, k))
            if best[1] is None:
                leaf = float(-rate * gs / (hs + ridge))
                step[rows] = leaf
                return leaf
            f, k = best[1]
            low = binned[rows, f] <= k
            return (f, float(cuts[f][k]), grow(rows[low], level - 1), grow(rows[~low], level - 1))

        trees.append(grow(np.arange(len(y)), depth))
        score = score + step
    return base, tuple(trees)


#: Labelled urls that train a model at most.
TRAIN_URLS = 8000
#: Rows of the mean label that block rates are smoothed with, and rows that a suffix or segment must have.
SMOOTHING, LEAST_SEEN = 20, 5


def sample_labelled(labelled: DataFrame, max_rows: int = TRAIN_URLS) -> DataFrame:
    """At most ``max_rows`` different urls of (url, label), the same in every run: those of least md5(url).  A url
    of several labels has the mean.  All rows are counted; only those whose hash is in a range that holds about
    four times ``max_rows`` rows are grouped, so a large table isn't shuffled.  Null labels are skipped."""
    rows = labelled.where("label is not null").select(F.coalesce("url", F.lit("")).alias("url"), F.col("label").cast("double").alias("label"))
    rows = rows.withColumn("h", F.md5(F.col("url").cast("binary")))
    share = min(1.0, 4.0 * max_rows / max(rows.count(), 1))
    near = rows.where(F.col("h") <= f"{int(share * 0xFFFFFFFF):08x}" + "g")
    return near.groupBy("h", "url").agg(F.avg("label").alias("label")).orderBy("h", "url").limit(max_rows).select("url", "label")


def train_url_model(labelled: DataFrame, max_rows: int = TRAIN_URLS, **trees) -> UrlModel:
    """A model from (url, label), label 1 for "block", on sample_labelled's rows.  Without rows every url
    scores 0.  Block rates of suffixes and first segments count the other rows only, so that no row sees its own
    label in them; those of fewer than LEAST_SEEN rows aren't known."""
    parts = with_parts(sample_labelled(labelled, max_rows))
    keys = [suffix_of(F.col("_host")).alias("suffix"), segment_of(F.col("_path")).alias("segment")]
    got = features(parts, {}).select(F.col("_x"), F.col("_row.label").alias("y"), *keys).collect()
    if not got:
        return UrlModel(0.0, (), {}, {})
    y = np.array([r["y"] for r in got])
    prior = float(y.mean())
    rate = lambda b, n: round((b + SMOOTHING * prior) / (n + SMOOTHING), 6)
    tables, seen = [], []
    for column in ("suffix", "segment"):
        tally: dict[str, list[float]] = {}
        for r in got:
            t = tally.setdefault(r[column], [0.0, 0.0])
            t[0] += r["y"]
            t[1] += 1
        tables.append({k: (rate(b, n), n) for k, (b, n) in tally.items() if n >= LEAST_SEEN})
        known = [tally[r[column]] if tally[r[column]][1] >= LEAST_SEEN else None for r in got]
        seen.append([(0.5, 0.0) if t is None else (rate(t[0] - r["y"], t[1] - 1), t[1]) for r, t in zip(got, known, strict=True)])
    x = np.array([[*r["_x"][:-3], *a, b[0]] for r, a, b in zip(got, *seen, strict=True)])
    base, grown = grow_trees(x, y, **trees)
    return UrlModel(base, grown, *tables)


def rule_labels(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """(url, label) of the urls that a rule fits: 1 for block, 0 for allow.  Repeated urls repeat; null urls fit
    no rule."""
    parts = with_parts(pages.select(url_col), url_col)
    verdict = matched_rule(F.col("_host"), F.col("_path"), rules)[1]
    return parts.select(F.col("_url").alias("url"), F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("label")).where("label is not null")


def judge_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """Each row of ``pages`` as _row (a struct), with host, path, rule, score and verdict: the longest
    fitting rule's verdict, else block where the model's log-odds are above 0.

    One narrow pass, no shuffle.  A null or scheme-less url has empty host and path, fits no rule and is
    judged by the model.  Empty input: empty output.  ``rules`` become expressions: meant for lists of
    hundreds, not for host lists of millions.
    """
    parts = features(with_parts(pages, url_col), model.suffixes, model.segments)
    rule, verdict = matched_rule(F.col("_host"), F.col("_path"), rules)
    scored = parts.select("_row", "_host", "_path", rule.alias("rule"), verdict.alias("_verdict"), model.score().alias("score"))
    return scored.select("_row", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "score", F.coalesce("_verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))
