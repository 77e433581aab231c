"""Readers, run counters and idempotent purges."""

import json
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from cartorio.operators import lifecycle
from cartorio.operators.counters import with_counters
from cartorio.operators.fields import write_extractions
from cartorio.sources.lines import read_captures, read_text_files, to_lines


def test_text_files_skip_binary_and_undecodable(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, content in {"a.txt": "um\r\ndois\n".encode(), "b.bin": b"x\x00y", "c.txt": b"\xff\xfe\xfa"}.items():
        with open(f"{folder}/{name}", "wb") as out:
            out.write(content)
    lines = to_lines(read_text_files(spark, folder), "path")
    assert [(r["path"].rsplit("/", 1)[-1], r["line_no"], r["line"]) for r in lines.orderBy("path", "line_no").collect()] == [("a.txt", 1, "um"), ("a.txt", 2, "dois")]


def test_capture_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    page = {"page": 1, "imageWidth": 10, "imageHeight": 20, "durationMs": 3, "blocks": [{"text": "CPF", "confidence": 0.9871, "boundingBox": [0, 0, 5, 0, 5, 5, 0, 5]}]}
    with open(f"{folder}/x.json", "w") as out:
        json.dump({"source": "s", "modelVersion": "m", "pages": [page]}, out, indent=1)
    row = read_captures(spark, folder).first()
    assert row["source"] == "s" and row["pages"][0]["blocks"][0]["text"] == "CPF" and row["pages"][0]["blocks"][0]["boundingBox"][2] == 5.0


def test_partitioned_publish_replaces_only_its_types(spark):
    target = tempfile.mkdtemp(prefix="spark-") + "/out"
    write_extractions(spark.createDataFrame([(1, "A"), (2, "B")], "doc_id int, document_type string"), target)
    write_extractions(spark.createDataFrame([(3, "B")], "doc_id int, document_type string"), target)
    assert sorted((r["doc_id"], r["document_type"]) for r in spark.read.parquet(target).collect()) == [(1, "A"), (3, "B")]


def test_purge_twice_is_purge_once_and_counts(spark):
    now = datetime(2024, 1, 1)
    old = datetime(2023, 1, 1)
    docs = spark.createDataFrame(
        [(1, "COMPLETED", old, None), (2, "COMPLETED", None, None), (3, "QUEUED", old, None), (4, "PURGED", old, old)],
        "doc_id int, status string, expires_at timestamp_ntz, purged_at timestamp_ntz",
    )
    extractions = spark.createDataFrame([(1, 10, "{}"), (2, 20, None)], "doc_id int, extraction_id int, structured string")
    fields = spark.createDataFrame([(10, "cpf"), (20, "cpf")], "extraction_id int, field_path string")
    once = lifecycle.purge(docs, extractions, fields, now)
    counted, seen = with_counters(once["documents"], "purge", {"purged": F.col("purged_at") == F.lit(now).cast("timestamp_ntz")})
    assert len(counted.collect()) == 4 and seen.get == {"rows": 4, "purged": 1}
    assert [r["details"] for r in once["events"].collect()] == ["reason=RETENTION_EXPIRED deleted=file,ocr_text,extracted_fields"]
    twice = lifecycle.purge(once["documents"], once["extractions"], once["fields"], now)
    assert twice["events"].count() == 0
    for part in ("documents", "extractions", "fields"):
        assert sorted(map(tuple, once[part].collect()), key=str) == sorted(map(tuple, twice[part].collect()), key=str)


def test_auto_approval_leaves_audit_rows(spark):
    requests = spark.createDataFrame(
        [(1, 7, "PENDING", datetime(2024, 1, 1), None, None), (2, 8, "APPROVED", datetime(2024, 1, 1), lifecycle.AUTO_APPROVER, None)],
        "request_id int, doc_id int, status string, requested_at timestamp_ntz, approved_by string, decided_at timestamp_ntz",
    )
    after = lifecycle.auto_approve(requests, datetime(2024, 1, 3))
    assert [(r["resource_id"], r["changes"]) for r in lifecycle.auto_approval_audit(requests, after).collect()] == [("1", "documentId=7 autoApproveAfter=1.00:00:00")]
