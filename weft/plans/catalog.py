"""Named queries over the library's own operators, with the SQL that gives the same rows.

The tables stand in as follows: ``embeddings`` for records (vec_id, vector, label as gold cluster),
``documents`` for text attributes, ``labels`` for gold and predicted truth; scores of pairs are made from
distances of the k-NN graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.judgement import parse_judgement, parse_verdict, score_or_skip, score_or_zero, truth
from weft.functions.scalars import cache_key, gold_cluster, same_cluster, squared_distance
from weft.functions.text import list_text, listing_details, pair_prompt, prompt_details, record_text, text_representation
from weft.operators import analysis, blocking, contraction, graph, judging, metrics, ml, pairs, review
from weft.operators.knn import knn, undirected
from weft.session import durable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without vectors: the column is pruned from the scan."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def knn_edges(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return undirected(knn(records(spark, sf_dir), k))


def scored(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Edges with a stand-in judge's score."""
    return knn_edges(spark, sf_dir, k).select("a", "b", F.round(1 - F.col("d2") / 4, 6).alias("score"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored edges with gold and predicted truth."""
    rows = metrics.labelled(scored(spark, sf_dir), clusters(spark, sf_dir))
    return rows.select("a", "b", "score", same_cluster(F.col("ca"), F.col("cb")).alias("gold"), (F.col("score") >= 0.75).alias("predicted"))


def components(spark: SparkSession, sf_dir: str, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(edges, components) of the k-NN graph."""
    edges = durable(knn_edges(spark, sf_dir, k))
    return edges, durable(graph.connected_components(edges, clusters(spark, sf_dir), "a", "b"))


def members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, comp = components(spark, sf_dir)
    return edges, comp.join(records(spark, sf_dir).select("id", "embedding"), "id")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# SQL parts: the graph of K neighbours, its components, scores.
KNN = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label AS cluster FROM embeddings),
dd AS (SELECT x.id AS src, y.id AS dst, list_sum(list_transform(list_zip(x.e, y.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM v x JOIN v y ON x.id <> y.id),
kn AS (SELECT * FROM (SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM dd) WHERE rank <= {k}),
ed AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(d2) AS d2 FROM kn GROUP BY ALL)"""
COMP = """bo AS (SELECT a AS s, b AS t FROM ed UNION SELECT b, a FROM ed),
re AS (SELECT id, id AS r FROM v UNION SELECT re.id, bo.t FROM re JOIN bo ON re.r = bo.s),
co AS (SELECT id, min(r) AS component FROM re GROUP BY id)"""
SCORED = """sc AS (SELECT a, b, round(1 - d2 / 4, 6) AS score FROM ed),
ju AS (SELECT a, b, score, x.cluster = y.cluster AS gold, score >= 0.75 AS predicted FROM sc JOIN v x ON a = x.id JOIN v y ON b = y.id)"""
GOLD = "go AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.cluster = y.cluster AND x.id < y.id)"


def sql_of(k: int, *parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([KNN.format(k=k), *parts]) + "\n" + then


@query(sql_of(10, then="SELECT src, dst, rank::INTEGER AS rank, round(d2, 6) AS d2 FROM kn"))
def knn_topk(spark, sf_dir):
    return rounded(knn(records(spark, sf_dir), 10), "d2")


@query(sql_of(10, then="SELECT a, b, round(d2, 6) AS d2 FROM ed"))
def knn_edges_undirected(spark, sf_dir):
    return rounded(knn_edges(spark, sf_dir, 10), "d2")


@query(sql_of(10, then="SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY rank) AS neighbors FROM kn GROUP BY src"))
def knn_adjacency(spark, sf_dir):
    from weft.sources.graphs import adjacency

    return adjacency(knn(records(spark, sf_dir), 10)).select("src", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(sql_of(10, then="SELECT a AS record_id_1, b AS record_id_2 FROM ed ORDER BY 1, 2"))
def candidate_pairs(spark, sf_dir):
    return pairs.canonical_pairs(knn(records(spark, sf_dir), 10), "src", "dst").select(F.col("a").alias("record_id_1"), F.col("b").alias("record_id_2")).orderBy("record_id_1", "record_id_2")


@query("SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id")
def gold_pairs(spark, sf_dir):
    return pairs.gold_pairs(clusters(spark, sf_dir))


@query("SELECT x.vec_id AS a, y.vec_id AS b, 1 AS label FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id")
def training_pos_pairs(spark, sf_dir):
    return pairs.positive_pairs(clusters(spark, sf_dir))


def _sample_sql(seed: str, size: str, p: str) -> str:
    """CTEs that end in ``{p}`` (a, b, t): the sample of cross pairs in its random order; needs q (id, c)."""
    turn = "\n".join(
        f"{p}{i} AS (SELECT t, m, k, r AS l, xor(l, ('0x' || substr(md5('{seed}:{i}:' || r), 1, 8))::BIGINT & ((1::BIGINT << k) - 1)) AS r FROM {p}{i - 1})," for i in range(1, pairs.ROUNDS + 1)
    )
    return f"""{p}po AS (SELECT id, c, row_number() OVER (ORDER BY substr(md5(c::VARCHAR), 1, 3), c, substr(md5(id::VARCHAR), 1, 3), id) - 1 AS pos FROM q),
{p}cl AS (SELECT c, min(pos) AS s, count(*) AS n FROM {p}po GROUP BY c),
{p}cu AS (SELECT s, n * s AS w, (sum(n * s) OVER (ORDER BY s) - n * s)::BIGINT AS lo FROM {p}cl),
{p}mm AS (SELECT sum(w)::BIGINT AS m, greatest(1, ceil(log2(sum(w)) / 2))::INTEGER AS k FROM {p}cu),
{p}tt AS (SELECT unnest(range(1::BIGINT << (2 * k))) AS t, m, k FROM {p}mm),
{p}0 AS (SELECT t, m, k, t >> k AS l, t & ((1::BIGINT << k) - 1) AS r FROM {p}tt),
{turn}
{p}ix AS (SELECT t, (l << k) | r AS i FROM {p}{pairs.ROUNDS} WHERE ((l << k) | r) < m ORDER BY t LIMIT {size}),
{p}at AS (SELECT t, s + (i - lo) // s AS px, (i - lo) % s AS py FROM {p}ix JOIN {p}cu ON i >= lo AND i < lo + w),
{p} AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, t FROM {p}at JOIN {p}po x ON px = x.pos JOIN {p}po y ON py = y.pos)"""


CROSS = "q AS (SELECT vec_id AS id, label AS c FROM embeddings WHERE label IS NOT NULL)"
POSITIVES = "(SELECT sum(n * (n - 1) // 2)::BIGINT FROM (SELECT count(*) AS n FROM q GROUP BY c))"


def _positives(c: DataFrame) -> int:
    return metrics.pair_counts(c).first()["gold_total"]


@query(f"WITH {CROSS}, {_sample_sql('neg', POSITIVES, 'ne')} SELECT a, b, 0 AS label FROM ne")
def training_neg_sample(spark, sf_dir):
    """As many negatives as there are positives."""
    c = clusters(spark, sf_dir)
    return pairs.negative_sample(c, _positives(c))


@query("SELECT vec_id AS id, label AS cluster FROM embeddings ORDER BY md5('rec:' || vec_id), vec_id LIMIT 200")
def record_sample(spark, sf_dir):
    return pairs.record_sample(clusters(spark, sf_dir), 200)


@query(f"""WITH {CROSS}, {_sample_sql('neg', '1000', 'ne')}, {_sample_sql('non', '(SELECT 1000 + count(*) FROM ne)', 'no')}
SELECT a, b FROM no WHERE NOT EXISTS (SELECT 1 FROM ne WHERE ne.a = no.a AND ne.b = no.b) ORDER BY t LIMIT 1000""")
def random_nonmatch(spark, sf_dir):
    """As many random non-matches as there are samples already."""
    c = clusters(spark, sf_dir)
    return pairs.nonmatch_sample(c, pairs.negative_sample(c, 1000), 1000)


@query(sql_of(1, COMP, then="SELECT id, component FROM co"))
def connected_components(spark, sf_dir):
    return components(spark, sf_dir)[1]


@query(sql_of(1, COMP, then="SELECT component, count(*) AS size FROM co GROUP BY component"))
def cluster_sizes(spark, sf_dir):
    return components(spark, sf_dir)[1].groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query(sql_of(1, COMP, then="SELECT 'knn_cluster_' || (dense_rank() OVER (ORDER BY component) - 1) AS name, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM co GROUP BY component"))
def cluster_listing(spark, sf_dir):
    from weft.sources.graphs import cluster_listing as listing

    return listing(components(spark, sf_dir)[1]).select("name", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


RECALL = """cn AS (SELECT component, cluster, count(*) AS n FROM {co} JOIN v USING (id) GROUP BY ALL),
pc AS (SELECT component, sum(n) AS m FROM cn GROUP BY ALL),
gt AS (SELECT sum(m * (m - 1) / 2) AS gold FROM (SELECT count(*) AS m FROM v GROUP BY cluster)),
eg AS (SELECT count(*) AS edges, count(*) FILTER (x.cluster = y.cluster) AS edges_gold FROM {ed} JOIN v x ON a = x.id JOIN v y ON b = y.id),
ro AS (SELECT (SELECT sum(m * (m - 1) / 2) FROM pc)::BIGINT AS potential, (SELECT sum(n * (n - 1) / 2) FROM cn)::BIGINT AS potential_gold, edges, edges_gold, gold FROM eg, gt)"""
RECALL_ROW = "SELECT potential, potential_gold, round(potential_gold::DOUBLE / gold, 6) AS potential_recall, edges, edges_gold, round(edges_gold::DOUBLE / gold, 6) AS edge_recall FROM ro"
CENTROID = """ce AS (SELECT component, list(m ORDER BY pos) AS c FROM (SELECT component, pos, avg(x) AS m FROM
  (SELECT component, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM co JOIN v USING (id)) GROUP BY ALL) GROUP BY component),
cd AS (SELECT x.component AS a, y.component AS b, list_sum(list_transform(list_zip(x.c, y.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM ce x JOIN ce y ON x.component < y.component)"""


@query(sql_of(1, COMP, RECALL.format(co="co", ed="ed"), then=RECALL_ROW))
def blocking_recall_s0(spark, sf_dir):
    edges, comp = components(spark, sf_dir)
    return rounded(metrics.component_recall(comp, edges, clusters(spark, sf_dir)), "potential_recall", "edge_recall")


def _merged(metric: str):
    def run(spark, sf_dir):
        edges, m = members(spark, sf_dir)
        m = durable(m)
        return rounded(metrics.component_recall(blocking.merge_closest(m, metric), edges, clusters(spark, sf_dir)), "potential_recall", "edge_recall")

    return run


MERGE = "be AS ({best}),\nme AS (SELECT id, coalesce(be.a, component) AS component FROM co LEFT JOIN be ON co.component = be.b)"
QUERIES["blocking_recall_a"] = _merged("centroid")
ORACLES["blocking_recall_a"] = sql_of(1, COMP, CENTROID, MERGE.format(best="SELECT a, b FROM cd ORDER BY d2, a, b LIMIT 1"), RECALL.format(co="me", ed="ed"), then=RECALL_ROW)
QUERIES["blocking_recall_b"] = _merged("shortest")
ORACLES["blocking_recall_b"] = sql_of(
    1, COMP,
    MERGE.format(best="SELECT least(x.component, y.component) AS a, greatest(x.component, y.component) AS b FROM dd JOIN co x ON src = x.id JOIN co y ON dst = y.id WHERE x.component <> y.component ORDER BY d2, 1, 2 LIMIT 1"),
    RECALL.format(co="me", ed="ed"), then=RECALL_ROW,
)

#: Scenario C's threshold on these tables: the usual 0.5 selects nothing here.
CLOSE = 0.7
BRIDGE = """cl AS (SELECT a AS ca, b AS cb FROM cd WHERE sqrt(d2) <= 0.7),
rx AS (SELECT ca, cb, x.id AS a, y.id AS b, dd.d2 FROM cl JOIN co x ON x.component = ca JOIN co y ON y.component = cb JOIN dd ON dd.src = x.id AND dd.dst = y.id),
st AS (SELECT ca, cb, b FROM (SELECT *, row_number() OVER (PARTITION BY ca, cb ORDER BY d2, a, b) AS r FROM rx) WHERE r = 1),
br AS (SELECT DISTINCT a, b FROM (SELECT rx.a, rx.b, row_number() OVER (PARTITION BY rx.ca, rx.cb ORDER BY rx.d2, rx.a) AS r FROM rx JOIN st ON rx.ca = st.ca AND rx.cb = st.cb AND rx.b = st.b) WHERE r <= 2)"""


@query(sql_of(1, COMP, CENTROID, BRIDGE, then="SELECT a, b FROM br"))
def bridge_edges_c(spark, sf_dir):
    _, m = members(spark, sf_dir)
    return blocking.bridges(durable(m), CLOSE, 2)


BRIDGED = """e2 AS (SELECT a, b FROM ed UNION SELECT least(a, b), greatest(a, b) FROM br),
b2 AS (SELECT a AS s, b AS t FROM e2 UNION SELECT b, a FROM e2),
r2 AS (SELECT id, id AS r FROM v UNION SELECT r2.id, b2.t FROM r2 JOIN b2 ON r2.r = b2.s),
c2 AS (SELECT id, min(r) AS component FROM r2 GROUP BY id)"""


@query(sql_of(1, COMP, CENTROID, BRIDGE, BRIDGED, RECALL.format(co="c2", ed="e2"), then=RECALL_ROW))
def blocking_recall_c(spark, sf_dir):
    edges, m = members(spark, sf_dir)
    all_edges, comp = blocking.bridged(durable(m), edges, CLOSE, 2)
    return rounded(metrics.component_recall(comp, all_edges, clusters(spark, sf_dir)), "potential_recall", "edge_recall")


@query("""WITH l AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
SELECT label, (pos - 1)::INTEGER AS dim, round(avg(x), 6) AS mean FROM l GROUP BY ALL""")
def centroids(spark, sf_dir):
    c = blocking.centroids(records(spark, sf_dir), "cluster")
    return rounded(c.select(F.col("component").alias("label"), F.posexplode("centroid").alias("dim", "mean")), "mean")


F1 = """tp AS (SELECT count(*) AS proposed, count(*) FILTER (x.cluster = y.cluster) AS tp FROM {ed} JOIN v x ON a = x.id JOIN v y ON b = y.id),
gn AS (SELECT (sum(m * (m - 1) / 2))::BIGINT AS g FROM (SELECT count(*) AS m FROM v GROUP BY cluster))"""
F1_ROW = "SELECT proposed, tp, proposed - tp AS fp, g - tp AS fn, round(tp::DOUBLE / proposed, 6) AS precision, round(tp::DOUBLE / g, 6) AS recall, round(2 * tp::DOUBLE / (proposed + g), 6) AS f1 FROM tp, gn"


@query(sql_of(10, F1.format(ed="ed"), then=F1_ROW))
def knn_f1(spark, sf_dir):
    return rounded(metrics.edge_quality(knn_edges(spark, sf_dir, 10), clusters(spark, sf_dir)), "precision", "recall", "f1")


@query(sql_of(10, "bo AS (SELECT a AS s, b AS t FROM ed UNION SELECT b, a FROM ed)", then="SELECT a, b, (SELECT count(*) FROM bo x JOIN bo y ON x.t = y.t WHERE x.s = ed.a AND y.s = ed.b) AS common FROM ed"))
def edge_common_neighbors(spark, sf_dir):
    return graph.common_neighbors(durable(knn_edges(spark, sf_dir, 10)))


CONTRACT = """se AS (SELECT a, b FROM ed JOIN v x ON a = x.id JOIN v y ON b = y.id WHERE x.cluster = y.cluster),
sb AS (SELECT a AS s, b AS t FROM se UNION SELECT b, a FROM se),
sr AS (SELECT id, id AS r FROM v UNION SELECT sr.id, sb.t FROM sr JOIN sb ON sr.r = sb.s),
so AS (SELECT id, min(r) AS component FROM sr GROUP BY id)"""


@query(sql_of(5, CONTRACT, then="SELECT id, component FROM so"))
def contraction_clusters(spark, sf_dir):
    return contraction.contract(knn_edges(spark, sf_dir, 5), clusters(spark, sf_dir))


ALL_PAIRS = """ct AS (SELECT cluster, component, count(*) AS n FROM {co} JOIN v USING (id) GROUP BY ALL),
ap AS (SELECT (SELECT sum(n) FROM ct)::BIGINT AS n, (SELECT sum(n * (n - 1) / 2) FROM ct)::BIGINT AS tp,
  (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY component))::BIGINT AS p, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY cluster))::BIGINT AS g)"""
ALL_PAIRS_ROW = """SELECT n, tp, p - tp AS fp, g - tp AS fn, (n * (n - 1) / 2)::BIGINT - p - g + tp AS tn, CASE WHEN p = 0 THEN 0 ELSE round(tp::DOUBLE / p, 6) END AS precision,
round(tp::DOUBLE / g, 6) AS recall, round(2 * tp::DOUBLE / (p + g), 6) AS f1 FROM ap"""


@query(sql_of(5, CONTRACT, ALL_PAIRS.format(co="so"), then=ALL_PAIRS_ROW))
def contraction_f1(spark, sf_dir):
    c = clusters(spark, sf_dir)
    comp = contraction.contract(knn_edges(spark, sf_dir, 5), c)
    return rounded(metrics.all_pairs_confusion(durable(metrics.contingency(comp, c))), "precision", "recall", "f1")


@query(sql_of(1, COMP, ALL_PAIRS.format(co="co"), then=ALL_PAIRS_ROW))
def allpairs_confusion(spark, sf_dir):
    _, comp = components(spark, sf_dir)
    return rounded(metrics.all_pairs_confusion(durable(metrics.contingency(comp, clusters(spark, sf_dir)))), "precision", "recall", "f1")


SCORES = """ct AS (SELECT cluster AS g, component AS p, count(*)::DOUBLE AS n FROM co JOIN v USING (id) GROUP BY ALL),
ga AS (SELECT g, sum(n) AS a FROM ct GROUP BY g), pa AS (SELECT p, sum(n) AS b FROM ct GROUP BY p),
t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS tp FROM ct),
m AS (SELECT sum(n / t * ln(t * n / (a * b))) AS mi FROM ct JOIN ga USING (g) JOIN pa USING (p), t),
ha AS (SELECT -sum(a / t * ln(a / t)) AS ha, sum(a * (a - 1) / 2) AS a2 FROM ga, t), hb AS (SELECT -sum(b / t * ln(b / t)) AS hb, sum(b * (b - 1) / 2) AS b2 FROM pa, t),
q AS (SELECT *, b2 - tp AS fp, a2 - tp AS fn, t * (t - 1) / 2 - a2 - b2 + tp AS tn FROM t, m, ha, hb)"""


@query(sql_of(1, COMP, SCORES, then="""SELECT round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi,
round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure FROM q"""))
def cluster_metrics(spark, sf_dir):
    _, comp = components(spark, sf_dir)
    t = durable(metrics.contingency(comp, clusters(spark, sf_dir)))
    return rounded(metrics.cluster_scores(t), "ari", "nmi", "homogeneity", "completeness", "v_measure")


TRIANGLES = """tr AS (SELECT e1.a AS u, e1.b AS v, e2.b AS w, e1.score AS p_uv, e2.score AS p_vw, e3.score AS p_wu FROM sc e1 JOIN sc e2 ON e1.b = e2.a JOIN sc e3 ON e3.a = e1.a AND e3.b = e2.b),
tt AS (SELECT *, p_uv * p_vw * (1 - p_wu) + p_vw * p_wu * (1 - p_uv) + p_wu * p_uv * (1 - p_vw) AS inconsistency FROM tr ORDER BY inconsistency DESC, u, v, w LIMIT 100)"""


@query(sql_of(10, SCORED, TRIANGLES, then="""SELECT tt.u, tt.v, tt.w, round(inconsistency, 6) AS inconsistency, p_uv, p_vw, p_wu, x.cluster = y.cluster AS true_uv, y.cluster = z.cluster AS true_vw, z.cluster = x.cluster AS true_wu,
x.cluster AS cluster_u, y.cluster AS cluster_v, z.cluster AS cluster_w FROM tt JOIN v x ON tt.u = x.id JOIN v y ON tt.v = y.id JOIN v z ON tt.w = z.id"""))
def triangles_top(spark, sf_dir):
    return rounded(review.top_triangles(durable(scored(spark, sf_dir)), clusters(spark, sf_dir)), "inconsistency")


REVIEW = """rp AS (SELECT DISTINCT a, b, score FROM (SELECT u AS a, v AS b, p_uv AS score FROM tt UNION ALL SELECT v, w, p_vw FROM tt UNION ALL SELECT u, w, p_wu FROM tt)),
rv AS (SELECT a, b, score, x.cluster AS ca, y.cluster AS cb, x.cluster = y.cluster AS gold FROM rp JOIN v x ON a = x.id JOIN v y ON b = y.id),
si AS (SELECT *, score >= 0.5 AS judged, CASE WHEN ('0x' || substr(md5('review:' || a || ':' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.9::DOUBLE THEN gold ELSE NOT gold END AS human FROM rv)"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters(spark, sf_dir)
    return review.review_pairs(review.top_triangles(durable(scored(spark, sf_dir)), c), c)


@query(sql_of(10, SCORED, TRIANGLES, REVIEW, then="SELECT a, b, score, ca, cb, gold FROM rv"))
def review_pairs(spark, sf_dir):
    return _reviewed(spark, sf_dir)


@query(sql_of(10, SCORED, TRIANGLES, REVIEW, then="SELECT a, b, score, judged, gold, 0.9::DOUBLE AS accuracy, human, judged = gold AS judge_right, human = gold AS human_right, judged <> gold AND human = gold AS corrected FROM si"))
def review_simulation(spark, sf_dir):
    return review.simulate_review(_reviewed(spark, sf_dir), 0.9)


@query(sql_of(10, SCORED, TRIANGLES, REVIEW, then="""SELECT count(*) AS known, count(*) FILTER (judged = gold) AS judge_right, count(*) FILTER (human = gold) AS human_right,
count(*) FILTER (judged <> gold) AS judge_wrong, count(*) FILTER (judged <> gold AND human = gold) AS corrected FROM si WHERE gold IS NOT NULL"""))
def simulation_stats(spark, sf_dir):
    return review.simulation_stats(review.simulate_review(_reviewed(spark, sf_dir), 0.9))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 1 AND toxic = 1) AS tp FROM labels)
SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp::DOUBLE / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp::DOUBLE / (tp + fn), 6) END AS recall,
CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) END AS f1 FROM c""")
def pair_confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rounded(metrics.label_confusion(rows, F.col("quality") == 1, F.col("toxic") == 1), "precision", "recall", "f1")


@query(sql_of(10, SCORED, then="""SELECT gold, count(*) AS count, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS min, round(quantile_cont(score, 0.25), 9) AS p25,
round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.75), 9) AS p75, max(score) AS max FROM ju GROUP BY gold"""))
def score_describe(spark, sf_dir):
    # Quartiles of six-digit scores have eight digits at most: nine never meet a tie.
    return rounded(rounded(analysis.describe(judged(spark, sf_dir), "gold"), "mean", "std"), "p25", "p50", "p75", digits=9)


@query(sql_of(10, SCORED, then="SELECT round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 9) AS median, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.25), 9) AS p25, round(quantile_cont(score, 0.75), 9) AS p75 FROM ju"))
def score_summary(spark, sf_dir):
    return rounded(rounded(analysis.summary(judged(spark, sf_dir)), "mean", "std"), "median", "p25", "p75", digits=9)


@query(sql_of(10, SCORED, """bi AS (SELECT i, printf('%.1f-%.1f', i / 10.0, (i + 1) / 10.0) AS bin FROM range(10) r(i)),
bs AS (SELECT bin, count(*) FILTER (gold) AS n_true, count(*) FILTER (NOT gold) AS n_false FROM bi LEFT JOIN ju ON (score > i / 10.0::DOUBLE OR (i = 0 AND score = 0)) AND score <= (i + 1) / 10.0::DOUBLE GROUP BY bin),
al AS (SELECT * FROM bs UNION ALL SELECT 'total', sum(n_true)::BIGINT, sum(n_false)::BIGINT FROM bs)""",
    then="""SELECT bin, n_true, n_false, n_true + n_false AS n_all, CASE WHEN n_true + n_false = 0 THEN 0 ELSE round(n_true::DOUBLE / (n_true + n_false) * 100, 2) END AS pct_true,
CASE WHEN n_true + n_false = 0 THEN 0 ELSE round(n_false::DOUBLE / (n_true + n_false) * 100, 2) END AS pct_false FROM al"""))  # fmt: skip
def score_bins(spark, sf_dir):
    return analysis.score_bins(judged(spark, sf_dir))


@query(sql_of(10, SCORED, then="SELECT count(*) FILTER (gold AND score BETWEEN 0.4 AND 0.6) AS near_true, count(*) FILTER (NOT gold AND score BETWEEN 0.4 AND 0.6) AS near_false, count(*) FILTER (score BETWEEN 0.4 AND 0.6) AS near_all FROM ju"))
def score_band(spark, sf_dir):
    return analysis.score_band(judged(spark, sf_dir))


@query(sql_of(10, SCORED, then="SELECT min(score) FILTER (predicted) AS min_true, max(score) FILTER (NOT predicted) AS max_false, max(score) FILTER (NOT predicted) < min(score) FILTER (predicted) AS has_gap FROM ju"))
def decision_gap(spark, sf_dir):
    return analysis.decision_gap(judged(spark, sf_dir))


@query(sql_of(10, SCORED, """en AS (SELECT min(score) AS lo, max(score) AS hi FROM ju),
hb AS (SELECT least(floor((score - lo) / (hi - lo) * 50), 49)::INTEGER AS bin, count(*) AS n FROM ju, en GROUP BY 1)""", then="SELECT i::INTEGER AS bin, coalesce(n, 0) AS n FROM range(50) r(i) LEFT JOIN hb ON bin = i"))
def score_histogram(spark, sf_dir):
    return analysis.histogram(judged(spark, sf_dir))


@query(sql_of(10, SCORED, """gr AS (SELECT gold, score AS s, count(*) AS n FROM ju GROUP BY ALL), sp AS (SELECT i / 49.0::DOUBLE AS x FROM range(50) r(i))""",
    then="SELECT gold, round(x, 6) AS x, round(sum(exp(-0.5::DOUBLE * pow((x - s) / 0.05::DOUBLE, 2)) / (0.05::DOUBLE * 2.5066282746310002::DOUBLE) * n) / sum(n), 6) AS density FROM gr, sp GROUP BY gold, x"))
def score_density(spark, sf_dir):
    return rounded(analysis.density(judged(spark, sf_dir), "gold"), "x", "density")


#: The judge's answers that a parser must read, with what is to be read: fixed values.
ANSWERS = [
    (1, "はい\n類似度スコア: 0.95\n理由: 完全に一致します。", "はい", 0.95, "完全に一致します。"),
    (2, "いいえ\n類似度スコア: 0.1\n理由: タイトルが異なります。\n詳細な差分はこちらです。", "いいえ", 0.1, "タイトルが異なります。\n詳細な差分はこちらです。"),
    (3, "はい\n類似度スコア: 1.0", "はい", 1.0, ""),
    (4, "いいえ", "いいえ", None, ""),
    (5, "類似度スコア: 0.7", "不明", 0.7, ""),
    (6, "理由: これはテストです。", "不明", None, "これはテストです。"),
    (7, "はい。\n類似度スコア:0.88\n理由: ほぼ一致。", "はい", 0.88, "ほぼ一致。"),
    (8, "データなし", "不明", None, ""),
    (9, "はい\n類似度スコア: 不明\n理由: スコアが出せません。", "はい", None, "スコアが出せません。"),
    (10, "はい\n類似度スコア: 0.6\n理由: これは一行目です。\nこれは二行目です。\nそして三行目。", "はい", 0.6, "これは一行目です。\nこれは二行目です。\nそして三行目。"),
]


def _literal(x) -> str:
    return "NULL" if x is None else f"{x}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


def answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t, *_ in ANSWERS], "id int, answer string")


@query(f"SELECT * FROM (VALUES {_values((i, j, s, r) for i, _, j, s, r in ANSWERS)}) t(id, judgement, score, reason)")
def parse_answers(spark, sf_dir):
    return answers(spark).select("id", parse_judgement(F.col("answer")).alias("p")).select("id", "p.judgement", "p.score", "p.reason")


@query("SELECT * FROM (VALUES (1, true, 0.95::DOUBLE), (2, false, 0.1), (3, true, 1.0), (4, false, 0.0), (5, true, 0.7), (6, NULL, NULL), (7, true, 0.88), (8, NULL, NULL), (9, true, 1.0), (10, true, 0.6)) t(id, is_similar, score)")
def judge_fallback(spark, sf_dir):
    return answers(spark).select("id", parse_verdict(F.col("answer")).alias("v")).select("id", "v.is_similar", "v.score")


RAW = [(1, "0.5", "true"), (2, "", "False"), (3, "none", "1"), (4, "abc", "0"), (5, None, "maybe"), (6, "N/A", None), (7, "1.5", "TRUE")]


@query("SELECT * FROM (VALUES (1, 0.5::DOUBLE, 0.5::DOUBLE, true), (2, 0.0, 0.0, false), (3, 0.0, 0.0, true), (4, 0.0, NULL, false), (5, 0.0, 0.0, true), (6, 0.0, 0.0, true), (7, 1.5, 1.5, true)) t(id, zeroed, skipped, truth)")
def coercions(spark, sf_dir):
    rows = spark.createDataFrame(RAW, "id int, score string, flag string")
    return rows.select("id", score_or_zero(F.col("score")).alias("zeroed"), score_or_skip(F.col("score")).alias("skipped"), truth(F.col("flag")).alias("truth"))


@query("""SELECT doc_id, concat_ws(' ', CASE WHEN lang <> '' THEN trim(lang) END, CASE WHEN source <> '' THEN trim(source) END) AS two_fields,
nullif(concat_ws(' ', nullif(trim(lang), ''), nullif(trim(source), '')), '') AS filled, lang || ', ' || source AS listed FROM documents""")
def text_fields(spark, sf_dir):
    f = [F.col("lang"), F.col("source")]
    return table(spark, sf_dir, "documents").select("doc_id", text_representation(f).alias("two_fields"), record_text(f).alias("filled"), list_text(F.array(*f)).alias("listed"))


DETAILS = "'タイトル: ' || coalesce(lang, 'タイトル不明') || chr(10) || '著者: ' || coalesce(source, '著者不明') || chr(10) || '出版社: ' || '出版社不明' || chr(10) || '出版日: ' || n_chars"


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    block = prompt_details(F.col("lang"), F.col("source"), none, F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), block.alias("details"))


@query(f"SELECT doc_id AS id, {DETAILS} AS details FROM documents")
def record_details(spark, sf_dir):
    return details(spark, sf_dir)


@query("SELECT doc_id AS id, 'タイトル: ' || lang || chr(10) || '著者: ' || source || chr(10) || '出版社: N/A' || chr(10) || '出版日: ' || n_chars AS details FROM documents")
def listing_text(spark, sf_dir):
    block = listing_details(F.col("lang"), F.array("source"), F.lit(None).cast("string"), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), block.alias("details"))


PROMPT = """'以下の2つの書誌情報が、実質的に同一の文献を指しているかどうかを判断してください。' || chr(10) || chr(10) || '書誌情報1:' || chr(10) || x.details || chr(10) || chr(10) || '書誌情報2:' || chr(10) || y.details
|| chr(10) || chr(10) || 'これらは同一の文献ですか？' || chr(10) || '回答:'"""
PROMPTED = f"""dt AS (SELECT doc_id AS id, {DETAILS} AS details FROM documents),
pp AS (SELECT a, b, gold, {PROMPT} AS prompt FROM ju JOIN dt x ON a = x.id JOIN dt y ON b = y.id)"""


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = details(spark, sf_dir)
    both = judged(spark, sf_dir).join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
    return both.select("a", "b", "gold", pair_prompt(F.col("da"), F.col("db")).alias("prompt"))


@query(sql_of(10, SCORED, PROMPTED, then="SELECT a, b, prompt FROM pp"))
def pair_prompts(spark, sf_dir):
    return prompted(spark, sf_dir).select("a", "b", "prompt")


@query(sql_of(10, then="SELECT least(a::VARCHAR, b::VARCHAR) || '_' || greatest(a::VARCHAR, b::VARCHAR) AS key FROM ed WHERE (a + b) % 3 <> 0"))
def cache_misses(spark, sf_dir):
    keyed = knn_edges(spark, sf_dir, 10).select("a", "b", cache_key(F.col("a"), F.col("b")).alias("key"))
    keyed = durable(keyed)
    return judging.cache_misses(keyed, keyed.where("(a + b) % 3 = 0")).select("key")


@query(sql_of(10, SCORED, then="SELECT a, b, gold AS is_similar, CASE WHEN gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, NULL::VARCHAR AS error FROM ju"))
def judged_pairs(spark, sf_dir):
    """Judging with a stand-in judge that reads the truth off the prompt; a third comes from the cache."""
    rows = durable(judged(spark, sf_dir).select("a", "b", "gold"))
    word = F.when(F.col("gold"), "はい").otherwise("いいえ")
    asked = rows.select("a", "b", word.alias("prompt"))
    cached = rows.where("(a + b) % 3 = 0").select(cache_key(F.col("a"), F.col("b")).alias("key"), F.col("gold").alias("is_similar"), F.col("gold").cast("int").cast("double").alias("score"))
    done, _ = judging.judge_pairs(asked, cached, lambda prompt: prompt)
    return done.select("a", "b", "is_similar", "score", "error")


@query(sql_of(10, SCORED, then="SELECT a, b, predicted AS predicted_before, score AS score_before, gold AS predicted_after, CASE WHEN gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score_after FROM ju"))
def before_after_join(spark, sf_dir):
    rows = durable(judged(spark, sf_dir))
    return judging.compare_models(rows, rows.select("a", "b", F.col("gold").alias("predicted"), F.col("gold").cast("int").cast("double").alias("score"))).drop("error_before", "error_after")


SYSTEM_SQL = """'あなたは2つの書誌情報が実質的に同一の文献を指すかどうかを判断する専門家です。' || chr(10) || 'まず、2つの書誌情報が同一の文献と思われる場合は「はい」、そうでない場合は「いいえ」で明確に回答してください。' || chr(10) || '次に、その判断の確信度を示す類似度スコアを0.0（全く異なる）から1.0（完全に同一）の範囲で提示してください。'"""


@query(sql_of(10, SCORED, PROMPTED, then=f"""SELECT '{{"messages":[{{"role":"system","content":' || to_json({SYSTEM_SQL}) || '}},{{"role":"user","content":' || to_json(prompt) || '}},{{"role":"assistant","content":' ||
to_json(CASE WHEN gold THEN 'はい' || chr(10) || '類似度スコア: 1.0' ELSE 'いいえ' || chr(10) || '類似度スコア: 0.0' END) || '}}]}}' AS sample FROM pp"""))
def finetune_messages(spark, sf_dir):
    return review.finetune_messages(prompted(spark, sf_dir), F.col("prompt"), F.col("gold"))


@query(f"""WITH {CROSS}, {_sample_sql('neg', POSITIVES, 'ne')},
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
p AS (SELECT x.id AS a, y.id AS b, 1 AS y FROM v x JOIN v y ON x.label = y.label AND x.id < y.id UNION ALL SELECT a, b, 0 FROM ne),
d AS (SELECT p.y, sqrt(list_sum(list_transform(list_zip(v1.e, v2.e), lambda q: (q[1] - q[2]) * (q[1] - q[2])))) AS d FROM p JOIN v v1 ON p.a = v1.id JOIN v v2 ON p.b = v2.id)
SELECT count(*) AS pairs, round(avg(y * d * d + (1 - y) * greatest(0, 1 - d) * greatest(0, 1 - d)), 6) AS loss FROM d""")
def contrastive_loss(spark, sf_dir):
    return rounded(ml.cluster_loss(records(spark, sf_dir), _positives(clusters(spark, sf_dir))), "loss")


@query("SELECT vec_id AS id, coalesce(CASE WHEN label <> 3 THEN label::VARCHAR END, 'gt_orphan_' || vec_id) AS cluster FROM embeddings")
def gold_with_orphans(spark, sf_dir):
    c = clusters(spark, sf_dir)
    return c.select("id", gold_cluster(F.when(F.col("cluster") != 3, F.col("cluster")), F.col("id")).alias("cluster"))


@query(sql_of(10, GOLD, then="SELECT (SELECT count(*) FROM (SELECT a, b FROM ed INTERSECT SELECT a, b FROM go)) AS in_both, (SELECT count(*) FROM (SELECT a, b FROM ed EXCEPT SELECT a, b FROM go)) AS only_proposed, (SELECT count(*) FROM (SELECT a, b FROM go EXCEPT SELECT a, b FROM ed)) AS only_gold, (SELECT count(*) FROM (SELECT a, b FROM ed UNION SELECT a, b FROM go)) AS in_either"))
def pair_set_ops(spark, sf_dir):
    """Sizes of the sets, by the clusters of proposed pairs and counts of clusters: gold pairs aren't made."""
    q = metrics.edge_quality(knn_edges(spark, sf_dir, 10), clusters(spark, sf_dir))
    return q.select(F.col("tp").alias("in_both"), F.col("fp").alias("only_proposed"), F.col("fn").alias("only_gold"), (F.col("proposed") + F.col("fn")).alias("in_either"))


@query()
def network_embeddings(spark, sf_dir):
    """Texts embedded by n-grams, then by the untrained network; no SQL form."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text_representation([F.col("lang"), F.col("source")]).alias("text"))
    out = ml.infer(ml.embed(texts), ml.Network.fresh(outputs=8))
    return out.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_sum(list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d2 FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def pair_distances(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "embedding")
    both = r.toDF("a", "va").join(r.select(F.col("id").alias("b"), (F.col("id") - 1).alias("a"), F.col("embedding").alias("vb")), "a")
    return both.select("a", "b", F.round(squared_distance(F.col("va"), F.col("vb")), 6).alias("d2"))


@query(sql_of(10, SCORED, then="""SELECT a AS record_id_1, b AS record_id_2, CASE WHEN gold THEN 'True' ELSE 'False' END AS ground_truth_similar, CASE WHEN predicted THEN 'True' ELSE 'False' END AS predicted_similar_before,
score AS score_before, CASE WHEN score < 0.6::DOUBLE THEN 'low' END AS error_before, CASE WHEN (a + b) % 5 <> 0 THEN CASE WHEN gold THEN 'True' ELSE 'False' END END AS predicted_similar_after,
CASE WHEN (a + b) % 5 <> 0 THEN 1 - score END AS score_after, CASE WHEN (a + b) % 5 <> 0 AND (a + b) % 7 = 0 THEN 'late' END AS error_after FROM ju"""))
def detailed_results(spark, sf_dir):
    """The file of two models' results; the second lacks a fifth of the pairs."""
    from weft.sources import layouts

    rows = durable(judged(spark, sf_dir))
    before = rows.select("a", "b", "predicted", "score", F.when(F.col("score") < 0.6, "low").alias("error"))
    after = rows.where("(a + b) % 5 <> 0").select("a", "b", F.col("gold").alias("predicted"), (1 - F.col("score")).alias("score"), F.when((F.col("a") + F.col("b")) % 7 == 0, "late").alias("error"))
    return layouts.detailed(rows.select("a", "b", "gold"), before, after)


@query(sql_of(10, SCORED, PROMPTED, then="""SELECT a AS record_id_1, b AS record_id_2, x.details AS bib_info_1, y.details AS bib_info_2, prompt AS llm_prompt, CASE WHEN gold THEN 'はい' || chr(10) || '類似度スコア: 0.9' ELSE 'いいえ' END AS llm_raw_response,
CASE WHEN gold THEN 'はい' ELSE 'いいえ' END AS llm_judgement, CASE WHEN gold THEN 0.9::DOUBLE END AS llm_similarity_score, '' AS llm_reason, 'ok' AS status FROM pp JOIN dt x ON a = x.id JOIN dt y ON b = y.id"""))
def results_file(spark, sf_dir):
    """The ten columns of a judge's result file; the stand-in judge answers by a mark behind the prompt."""
    from weft.sources import layouts

    rows = durable(prompted(spark, sf_dir))
    asked = rows.select("a", "b", F.concat(F.col("prompt"), F.when(F.col("gold"), "#y").otherwise("#n")).alias("prompt"))
    said = judging.explain_pairs(asked, lambda prompt: "はい\n類似度スコア: 0.9" if prompt.endswith("#y") else "いいえ")
    said = said.withColumn("prompt", F.expr("substr(prompt, 1, length(prompt) - 2)"))
    return layouts.results(said, details(spark, sf_dir))


@query(sql_of(10, SCORED, """po AS (SELECT a AS s, b AS t FROM ju WHERE score >= 0.66::DOUBLE UNION SELECT b, a FROM ju WHERE score >= 0.66::DOUBLE),
iv AS (SELECT a AS id FROM ju UNION SELECT b FROM ju), pr AS (SELECT id, id AS r FROM iv UNION SELECT pr.id, po.t FROM pr JOIN po ON pr.r = po.s)""", then="SELECT id, min(r) AS component FROM pr GROUP BY id"))
def predicted_clusters(spark, sf_dir):
    """Clusters that positive judgements make of the judged records."""
    rows = durable(judged(spark, sf_dir))
    ids = rows.select(F.col("a").alias("id")).union(rows.select("b")).distinct()
    return graph.clusters_of(ids, rows.where(F.col("score") >= 0.66))


@query(sql_of(10, then="SELECT a, b FROM ed WHERE a % 3 <> 0 AND b % 3 <> 0"))
def trainable_pairs(spark, sf_dir):
    return pairs.trainable(knn_edges(spark, sf_dir, 10).select("a", "b"), clusters(spark, sf_dir).where("id % 3 <> 0"))


@query("SELECT coalesce(CASE WHEN label <> 3 THEN label::VARCHAR END, 'unknown_cluster') AS cluster_id, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_summary(spark, sf_dir):
    from weft.sources.records import cluster_summary as summary

    return summary(clusters(spark, sf_dir).select(F.when(F.col("cluster") != 3, F.col("cluster").cast("string")).alias("cluster_id")))


@query(sql_of(1, COMP, f"""dt AS (SELECT doc_id AS id, {DETAILS} AS details FROM documents WHERE doc_id % 4 <> 0)""", then="""SELECT 'contracted_cluster_' || dense_rank() OVER (ORDER BY component) || '_node_' || component AS name,
string_agg(co.id || '=' || coalesce(details, 'Details not found for ' || co.id), ';' ORDER BY co.id) AS members FROM co LEFT JOIN dt ON co.id = dt.id GROUP BY component"""))
def cluster_details(spark, sf_dir):
    """Clusters with their members' texts, of which some are missing."""
    from weft.sources.graphs import cluster_listing as listing

    got = listing(components(spark, sf_dir)[1], "contracted_cluster_", details(spark, sf_dir).where("id % 4 <> 0"), first=1, node=True)
    return got.select("name", F.array_join(F.transform("members", lambda m: F.concat_ws("=", m["record_id"].cast("string"), m["details"])), ";").alias("members"))


@query("""SELECT doc_id AS id, 'タイトル: ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source, 'タイトル不明') || chr(10) || '著者: ' || CASE WHEN doc_id % 3 = 0 THEN '著者不明' ELSE lang || ', ' || source END || chr(10)
|| '出版社: ' || coalesce(CASE WHEN doc_id % 5 = 0 THEN lang END, '出版社不明') || chr(10) || '出版日: ' || n_chars AS details, CASE WHEN doc_id % 4 = 0 THEN 'unknown_model' ELSE 'ft_' || lang || '-' || source END AS model FROM documents""")
def generic_details(spark, sf_dir):
    """Details by generic names first, and model names made fit for files."""
    from weft.functions.text import file_safe_model, prompt_details_any

    none, n = F.lit(None).cast("string"), F.col("doc_id")
    block = prompt_details_any(
        F.when(n % 2 == 0, F.col("lang")), F.col("source"), F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")),
        F.when(n % 5 == 0, F.col("lang")), none, none, F.col("n_chars").cast("string"),
    )
    model = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("ft:"), F.col("lang"), F.lit("/"), F.col("source")))
    return table(spark, sf_dir, "documents").select(n.alias("id"), block.alias("details"), file_safe_model(model).alias("model"))
