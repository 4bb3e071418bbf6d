"""The queries over this package's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.mixing import mix_sources

    mix = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget_ratio=1.5, max_repeats=2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
t0 AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM s GROUP BY ALL),
t1 AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight,
              row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, (2 * source_size)::DOUBLE AS cap,
              (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM t0),
t2 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t1),
t3 AS (SELECT *, cap / weight <= level AS capped FROM t2),
t4 AS (SELECT *, max(CASE WHEN NOT capped THEN level END) OVER () AS water FROM t3),
t AS (SELECT skey, source_size, weight, budget, CASE WHEN capped THEN cap ELSE weight * water END AS target FROM t4),
q AS (SELECT s.doc_id, s.skey, s.size, t.source_size, t.weight, t.target, t.budget,
             sum(size) OVER (PARTITION BY s.skey ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served,
             row_number() OVER () AS rid
      FROM s JOIN t USING (skey)),
c AS (SELECT *, (served + k * source_size)::DOUBLE / weight AS finish FROM q, (VALUES (0), (1)) v(k)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, served, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c WHERE size > 0),
n AS (SELECT rid, sum(size)::BIGINT AS taken FROM r WHERE upto <= budget GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(n.taken, 0)::BIGINT AS taken FROM q LEFT JOIN n USING (rid)
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.quality import quality_rules, train_line_crf

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train_line_crf(docs, table(spark, sf_dir, "labels")))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.urls import RULES, judge_urls, rule_labels, train_url_model

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = train_url_model(rule_labels(pages, RULES))
    return judge_urls(pages, model, RULES).select("_row.page_id", "host", "path", "rule", "verdict")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.secrets import BASE, joined, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.warc import read_archives, write_archives

    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM g
"""


def op7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.lengths import encoded_lengths, length_histogram

    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))


def op8_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.webp import read_media, store_texts

    return read_media(store_texts(table(spark, sf_dir, "documents")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.bpe import default_path, encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents"), default_path(), decoded=True)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)])
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS sh FROM d),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
u AS (SELECT doc_id, md5_number(unnest(sh)) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM u x JOIN u y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT id, min(reach) AS low FROM r GROUP BY id)
SELECT n.doc_id, n.n_shingles, coalesce(m.low, n.doc_id) AS component_id, n.doc_id = coalesce(m.low, n.doc_id) AS kept
FROM n LEFT JOIN m ON n.doc_id = m.id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name: every operator over its whole table."""
    return {"op1_mix": op1_mix, "op2_quality": op2_quality, "op3_urls": op3_urls, "op4_html": op4_html, "op5_secrets": op5_secrets, "op6_warc": op6_warc, "op7_lengths": op7_lengths, "op8_webp": op8_webp, "op9_bpe": op9_bpe, "op10_neardup": op10_neardup}


def oracle_sql() -> dict[str, str]:
    """By name: the same rows in DuckDB's SQL, where SQL can express them."""
    return {"op1_mix": OP1_SQL, "op6_warc": OP6_SQL, "op10_neardup": OP10_SQL}
