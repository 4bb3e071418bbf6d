"""Record datasets in YAML: readers of every accepted layout, a data source, and the writer of samples."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from weft import session

SCHEMA = "ord bigint, record_id string, cluster_id string, data map<string,string>"
#: Top-level keys that describe a dataset and hold no records: fixed values.
METADATA_KEYS = ("version", "type", "id", "summary", "inf_attr")


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return ", ".join(str(x) for x in v) if isinstance(v, list) else str(v)


def flatten(doc, tolerant: bool = False) -> Iterator[tuple]:
    """(ord, record_id, cluster_id, data) of a parsed document.

    The plain layout is a ``records`` map of clusters.  ``tolerant`` also takes a map of clusters at the root
    (metadata keys skipped) and a list of records, and reads a record without ``data`` as all its keys but
    id and cluster_id.  Anything else has no records; empty clusters and what isn't a record are skipped.
    """
    groups: list[tuple] = []
    if isinstance(doc, dict) and isinstance(doc.get("records"), dict):
        groups = list(doc["records"].items())
    elif tolerant and isinstance(doc, dict):
        groups = [(k, v) for k, v in doc.items() if k not in METADATA_KEYS and isinstance(v, list)]
    elif tolerant and isinstance(doc, list):
        groups = [(None, doc)]
    n = 0
    for cluster, rows in groups:
        for r in rows or []:
            if not isinstance(r, dict) or r.get("id") is None:
                continue
            data = r.get("data")
            if data is None:
                data = {k: v for k, v in r.items() if k not in ("id", "cluster_id")} if tolerant else {}
            own = r.get("cluster_id", cluster)
            yield n, str(r["id"]), None if own is None else str(own), {str(k): _text(v) for k, v in data.items()}
            n += 1


def load(path: str):
    """A parsed YAML file, in any store that Arrow opens; None if it is missing or broken."""
    import yaml

    try:
        store, at = session.storage(path)
        with store.open_input_stream(at, compression=None) as f:
            return yaml.load(f.read().decode("utf-8"), Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (OSError, UnicodeDecodeError, yaml.YAMLError):
        return None


class RecordReader(DataSourceReader):
    def __init__(self, path: str, tolerant: bool):
        self.path, self.tolerant = path, tolerant

    def read(self, partition) -> Iterator[tuple]:
        yield from flatten(load(self.path), self.tolerant)


class RecordSource(DataSource):
    """``spark.read.format("bibrecords").load(path)``: one YAML document is one partition, parsed by an
    executor that sees the path."""

    @classmethod
    def name(cls) -> str:
        return "bibrecords"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], self.options.get("tolerant", "false") == "true")


def read_records(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """(ord, record_id, cluster_id, data) of a YAML dataset; no rows if it can't be read."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("bibrecords").option("tolerant", str(tolerant).lower()).load(path)


def bibliographic(records: DataFrame) -> DataFrame:
    """The four bibliographic attributes as columns; missing ones are null, empty ones stay empty."""
    return records.select("record_id", "cluster_id", *[F.col("data")[f"bib1_{k}"].alias(k) for k in ("title", "author", "publisher", "pubdate")])


def one_per_id(records: DataFrame) -> DataFrame:
    """The first data and the last cluster of each id."""
    return records.groupBy("record_id").agg(F.max_by("cluster_id", "ord").alias("cluster_id"), F.min_by("data", "ord").alias("data"))


def record_clusters(records: DataFrame) -> DataFrame:
    """(record_id, cluster_id) of records that have both."""
    return records.where("record_id is not null and cluster_id is not null").select("record_id", "cluster_id")


def cluster_summary(records: DataFrame) -> DataFrame:
    """(cluster_id, n): records of each cluster; a missing one is called unknown_cluster."""
    return records.groupBy(F.coalesce("cluster_id", F.lit("unknown_cluster")).alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))


def write_sample(sample: DataFrame, path: str, metadata: dict | None = None) -> None:
    """A bounded sample as a YAML dataset with a fresh summary; the rows pass through the driver."""
    import yaml

    groups: dict[str, list] = {}
    for r in sample.orderBy("ord").toLocalIterator():
        groups.setdefault(r["cluster_id"] or "unknown_cluster", []).append({"id": r["record_id"], "cluster_id": r["cluster_id"], "data": dict(r["data"] or {})})
    now = datetime.now().strftime("%Y-%m-%d %H:%M:%S.%f")[:-3]
    summary = {**((metadata or {}).get("summary") or {}), "update_date": now, "num_of_records": sum(map(len, groups.values())), "num_of_pairs": {k: len(v) for k, v in groups.items()}}
    doc = {k: v for k, v in (metadata or {}).items() if k != "records"} | {"summary": summary, "records": groups}
    Path(path).write_text(yaml.safe_dump(doc, allow_unicode=True, sort_keys=False), encoding="utf-8")


def numbered(records: DataFrame) -> DataFrame:
    """Rows that came without ``ord``, numbered by id, by ranges of it."""
    return session.numbered(records, "record_id", "ord")
