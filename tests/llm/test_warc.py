import gzip
import hashlib

import pytest

from weft.llm.warc import gzip_stream, inflate, normalise, normalise_archives, page_record, read_archives, read_member, split_records, write_archives


def record(i, body=b"<p>x</p>", refers=None):
    return page_record(i, f"http://a/{i}", body, hashlib.sha1(body).hexdigest(), refers)


def test_normalise_both_kinds_of_file():
    records = [record(i, b"z" * (i * 1000)) for i in range(20)] + [record(99, b"z", 3)]
    whole = gzip_stream(records)
    members = b"".join(gzip.compress(r) for r in records)
    for data in (whole, members, members + b"\0" * 7):
        for step in (7, 1000, len(data)):
            body, index = normalise(data[i : i + step] for i in range(0, len(data), step))
            assert len(index) == 21
            assert b"".join(gzip.decompress(body[e.offset : e.offset + e.length]) for e in index) == b"".join(records)
    head, http, payload = read_member(body, index[5].offset, index[5].length)
    assert payload == b"z" * 5000 and head["warc-record-id"] == "<urn:page:5>" == index[5].record_id
    assert read_member(body, index[20].offset, index[20].length)[0]["warc-refers-to"] == "<urn:page:3>"


def test_broken_files():
    whole = gzip_stream([record(1, b"q" * 5000)])
    with pytest.raises(EOFError):
        normalise([whole[: len(whole) // 2]])
    with pytest.raises(EOFError):
        list(split_records([record(1)[:100]]))
    assert list(inflate([])) == [] == list(split_records([]))


def test_archives(spark):
    big = "<p>" + "same " * 400 + "</p>"
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"own {i}" if i % 3 == 1 else "short") for i in range(90)]
    rows += [(None, None, None), (None, "http://h/n", big), (500, "bad\r\nurl", ""), (87, "http://h/87", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    for broadcast in (100_000, 0):
        got = read_archives(write_archives(df, archive_bytes=4096, broadcast_rows=broadcast)).collect()
        assert len(got) == len(rows)
        want = []
        for i, _, h in rows:
            data = (h or "").encode()
            again = h == big and i != 87
            want.append((i if i is not None else -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 87 if again else -1))
        assert sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in got) == sorted(want)
    assert read_archives(write_archives(df.limit(0))).count() == 0


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip_stream([record(i) for i in range(5)]))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert read_archives(normalise_archives(files)).count() == 5


def test_files_lie_beside_their_sidecars(spark, tmp_path):
    import json

    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    archives = write_archives(df, archive_bytes=4096, folder=str(tmp_path / "out")).collect()
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert len(archives) > 3 and names == sorted(n for a in archives for n in (a["archive"].split("/")[-1], a["archive"].split("/")[-1] + ".idx"))
    seen = 0
    for a in archives:
        data = open(a["archive"], "rb").read()
        lines = [json.loads(x) for x in open(a["archive"] + ".idx", encoding="utf-8")]
        assert (len(lines), len(data)) == (a["records"], a["bytes"])
        for e in lines:
            head, _, payload = read_member(data, e["offset"], e["length"])
            page = int(e["record_id"].removeprefix("<urn:page:").removesuffix(">"))
            assert payload.decode() == rows[page][2] and head["warc-target-uri"] == e["uri"] == rows[page][1]
            seen += 1
    assert seen == 200


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://a/1", "<p>x</p>"), (1, "http://a/1", "<p>x</p>"), (2, "http://ä/\u2028", "é" * 300_000), (None, None, None), (3, "", ""), (4, "u", "long " * 400), (4, "u", "long " * 400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("digest", "refers_to", "n", "archive", "records", "bytes", "_page", "offset")])
    got = read_archives(write_archives(df), tasks=3).collect()
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"]) for r in got) == sorted((i or -1, len((h or "").encode()), "response") for i, _, h in rows)
    assert {r["url"] for r in got} == {"http://a/1", "http://ä/\u2028", None, "", "u"}


def test_streamed_in_pieces(spark, tmp_path, monkeypatch):
    """A file larger than what is read at once, by path and by content."""
    import os

    blocks = [os.urandom(200_000) for _ in range(30)]
    (tmp_path / "a.warc.gz").write_bytes(gzip_stream([record(i, b) for i, b in enumerate(blocks)]))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    want = sorted((i, hashlib.sha1(b).hexdigest()) for i, b in enumerate(blocks))
    for stream in (True, False):
        got = read_archives(normalise_archives(files, str(tmp_path / f"out{stream}"), stream)).collect()
        assert sorted((r["page_id"], r["payload_digest"]) for r in got) == want
    assert normalise_archives(files.limit(0)).count() == 0
