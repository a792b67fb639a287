import gzip
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdikt.llm import warc

PAGES = "page_id long, url string, html string"


def pages(spark):
    long = "é" * 60
    rows = [(5, "u5", long), (3, "u3", long), (4, "u4", long), (1, "u1", "short"), (2, "u2", "short"), (6, "u6", None), (7, None, ""), (8, "u8\r\nX: y", "z" * 200_000), (9, "u9", long[:-1])]
    return spark.createDataFrame(rows, PAGES)


def brute(rows):
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        first = min(same) if same and len(b) >= 100 else p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if first != p else "response", first if first != p else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = pages(spark)
    got = sorted((tuple(r) for r in warc.round_trip(df.withColumn("payload", F.lit(1)).withColumn("digest", F.lit(1))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute([tuple(r) for r in df.collect()])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_filters_and_skipping(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(warc.page_records(pages(spark)), path)
    df = warc.read(spark, path, payload=False)
    assert df.where("record_type = 'revisit'").count() == 2
    assert df.where("target_uri like 'u8%'").first()["target_uri"] == "u8  X: y"
    assert df.where("record_id in ('<urn:page:1>', '<urn:page:2>')").where("payload is null").count() == 2
    assert df.where("refers_to is not null").select("record_id").distinct().count() == 2
    plan = df.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(record_type,revisit)" in plan or "record_type" in plan
    full = warc.read(spark, path).where("record_id = '<urn:page:8>'").first()
    assert bytes(full["payload"]) == b"z" * 200_000


def test_members_are_gzip_and_foreign_files_are_read(spark, tmp_path):
    head, body = warc.record("response", b"hello\r\n\r\nworld", {"WARC-Target-URI": "u"})
    assert gzip.decompress(warc.member(head, body)) == head + body
    (tmp_path / "a.warc").write_bytes(head + body + head + body)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(head + body) + gzip.compress(head + body) + warc.member(head, body))
    for payload in (True, False):
        rows = warc.read(spark, str(tmp_path), payload=payload).collect()
        assert len(rows) == 5 and {r["target_uri"] for r in rows} == {"u"}
        assert {r["payload"] and bytes(r["payload"]) for r in rows} == ({b"hello\r\n\r\nworld"} if payload else {None})


def test_files_roll_and_lost_files_are_ignored(spark, tmp_path):
    rows = warc.page_records(spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("html")))
    warc.register(spark)
    rows.coalesce(1).write.format("warc").mode("append").option("path", str(tmp_path / "w")).option("roll", 2000).save()
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"\x1f\x8bgarbage")
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 3
    assert warc.read(spark, str(tmp_path / "w")).where("record_type = 'response'").count() == 50


def read_bytes(raw, payload=True):
    return [(h.get("x"), p) for _, h, p in warc.records(pa.BufferReader(raw), lambda h: True, payload)]


@pytest.mark.parametrize("compress", [False, True])
def test_long_headers_and_blank_lines(compress):
    """Headers far beyond a chunk, payloads beyond several, and blank lines between records."""
    pack = gzip.compress if compress else lambda x: x
    big = b"q" * 300_000
    raw = b""
    for i in range(3):
        head, body = warc.record("response", big if i == 1 else b"hello", {"X": str(i) * (200_000 if i else 1)})
        raw += pack(head + body) + b"\r\n"
    for payload in (True, False):
        got = read_bytes(raw, payload)
        assert [len(x) for x, _ in got] == [1, 200_000, 200_000]
        assert [p for _, p in got] == ([b"hello", big, b"hello"] if payload else [None] * 3)


@pytest.mark.parametrize("make", [lambda h, b: h + b, lambda h, b: gzip.compress(h + b), warc.member])
def test_truncated_records_are_errors(make):
    one = make(*warc.record("response", bytes(range(256)) * 2000, {"X": "1"}))
    assert len(read_bytes(one + one)) == 2
    for cut in (10, len(one) // 2, len(one) - 9):
        for payload in (True, False):
            with pytest.raises(warc.Truncated):
                list(read_bytes(one + one[:cut], payload))
    with pytest.raises(warc.Truncated):
        read_bytes(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nhello")


def test_overwrite_and_two_commits(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = lambda n: warc.page_records(spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("x").alias("html")))
    warc.write(rows(3), path)
    warc.write(rows(4), path)
    assert warc.read(spark, path).where("record_type = 'response'").count() == 7
    rows(2).write.format("warc").mode("overwrite").option("path", path).save()
    assert warc.read(spark, path).where("record_type = 'response'").count() == 2
    named = {f.name for f in (tmp_path / "w").iterdir()}
    assert sum(n.startswith("_manifest") for n in named) == 1


def test_paths_without_a_scheme_are_those_of_the_default_file_system(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    held = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://127.0.0.1:8020")
        assert warc.qualified(spark, "/shared/x") == "hdfs://127.0.0.1:8020/shared/x"
        assert warc.qualified(spark, f"file:{tmp_path}/x") == f"file://{tmp_path}/x" == warc.qualified(spark, f"file://{tmp_path}/x")
    finally:
        conf.set("fs.defaultFS", held)
    assert warc.qualified(spark, f"{tmp_path}/a b") == f"file://{tmp_path}/a b"
