"""A stream gives what its batch twin gives, however the rows are split into micro-batches."""

import json
import tempfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cartorio.operators import intake, lifecycle, notices
from cartorio.sources.rules import load_rules, profile_json
from cartorio.streaming import incremental, states

START = datetime(2024, 3, 1)


def run_stream(spark, rows, schema, build, splits, name):
    """Writes each split as a file, reads the folder as a stream one file at a time, returns the sink rows."""
    folder, checkpoint = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    for number, split in enumerate(splits):
        spark.createDataFrame(split, schema).coalesce(1).write.mode("append").json(f"{folder}/part={number:03d}")
    states.use_rocksdb(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/part=*")
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


UPLOADS = [
    ("a", 1, "x", START), ("a", 2, "x", START + timedelta(hours=3)), ("b", 3, "y", START + timedelta(hours=4)), ("a", 4, "z", START + timedelta(hours=23)),
    ("a", 5, "z", START + timedelta(hours=24)), ("a", 6, "z", START + timedelta(hours=40)), ("b", 7, "y", START + timedelta(hours=60)), ("a", 8, "x", START + timedelta(hours=47)),
]


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 5]])
def test_replay_stream_equals_batch(spark, cuts):
    rows = sorted(UPLOADS, key=lambda r: r[3])
    edges = [0, *cuts, len(rows)]
    splits = [rows[a:b] for a, b in zip(edges, edges[1:])]
    schema = "key string, upload_id bigint, digest string, uploaded_at timestamp"
    streamed = run_stream(spark, rows, schema, states.replay_stream, splits, f"replay_{len(cuts)}")
    twin = intake.replay_guard(spark.createDataFrame(rows, schema.replace("timestamp", "timestamp_ntz"))).select("upload_id", "outcome", "answered_by")
    assert sorted(streamed) == sorted(tuple(r) for r in twin.collect())
    assert (4, "CONFLICT", 1) in streamed and (5, "NEW", 5) in streamed and (8, "CONFLICT", 5) in streamed


def test_stuck_stream_equals_batch(spark):
    at = lambda minutes: START + timedelta(minutes=minutes)
    rows = [(1, at(0), "RUNNING"), (2, at(0), "RUNNING"), (1, at(2), "RUNNING"), (2, at(1), "DONE"), (3, at(7), "RUNNING"), (4, at(30), "DONE")]
    schema = "job_id bigint, seen_at timestamp, status string"
    streamed = run_stream(spark, rows, schema, states.stuck_stream, [rows[:2], rows[2:4], rows[4:5], rows[5:]], "stuck")
    beats = spark.createDataFrame(rows, schema.replace("timestamp", "timestamp_ntz")).withColumn("doc_id", F.col("job_id"))
    twin = notices.stuck_work(beats, at(29)).select("job_id", "details")
    assert sorted(streamed) == sorted(tuple(r) for r in twin.collect()) == [(1, "STUCK_JOB_RECOVERED"), (3, "STUCK_JOB_RECOVERED")]


def test_approval_stream_equals_batch(spark):
    at = lambda hours: START + timedelta(hours=hours)
    rows = [(1, at(0), "PENDING"), (2, at(1), "PENDING"), (2, at(5), "REJECTED"), (3, at(20), "PENDING"), (9, at(30), "REJECTED"), (9, at(31), "REJECTED")]
    schema = "request_id bigint, at timestamp, status string"
    streamed = run_stream(spark, rows, schema, states.approval_stream, [rows[:2], rows[2:4], rows[4:5], rows[5:]], "approvals")
    snapshot = [(1, "PENDING", at(0)), (2, "REJECTED", at(1)), (3, "PENDING", at(20))]
    requests = spark.createDataFrame(
        [(i, s, t, None, None) for i, s, t in snapshot], "request_id bigint, status string, requested_at timestamp_ntz, approved_by string, decided_at timestamp_ntz"
    )
    twin = lifecycle.auto_approve(requests, at(30)).filter("status = 'APPROVED'").select("request_id", "status", "approved_by")
    assert sorted(streamed) == sorted(tuple(r) for r in twin.collect()) == [(1, "APPROVED", "system:auto-approve-24h")]


def test_depth_stream_equals_batch(spark):
    rows = [(START + timedelta(seconds=20 * n), "PENDING" if n % 3 else "RUNNING") for n in range(30)] + [(START + timedelta(hours=2), "DONE")]
    schema = "at timestamp, status string"
    streamed = run_stream(spark, rows, schema, lambda s: states.depth_per_minute(s, "5 minutes"), [rows[:10], rows[10:30], rows[30:]], "depth")
    twin = states.depth_per_minute(spark.createDataFrame(rows[:30], schema))
    assert sorted(streamed) == sorted(tuple(r) for r in twin.collect())


def test_fan_out_and_retry_run_on_streams(spark):
    rows = [(n, ["COMPLETED", "FAILED", "QUEUED"][n % 3], "P0" if n % 2 else None, START + timedelta(minutes=n), n % 4 + 1, n % 2 == 0) for n in range(12)]
    schema = "doc_id bigint, status string, product_id string, occurred_at timestamp, attempt int, transient boolean"
    subscriptions = spark.createDataFrame(
        [(1, ["document.completed"], None, True), (2, ["document.failed", "document.completed"], "P0", True), (3, ["document.failed"], None, False)],
        "subscription_id int, events array<string>, product_id string, active boolean",
    )

    def build(df):
        named = df.withColumns({"protocol": F.lit("p"), "detected_type": F.lit(None).cast("string"), "product_code": F.col("product_id")})
        return notices.fan_out(named, subscriptions).select("doc_id", "subscription_id", "event", "payload")

    streamed = run_stream(spark, rows, schema, build, [rows[:5], rows[5:]], "fan")
    assert sorted(streamed) == sorted(tuple(r) for r in build(spark.createDataFrame(rows, schema)).collect())
    assert (1, 2, "document.failed") in [r[:3] for r in streamed] and not any(r[1] == 3 for r in streamed)

    retry = lambda df: notices.retry_plan(df.withColumn("failed_at", F.col("occurred_at"))).select("doc_id", "job_status", "available_at")
    streamed = run_stream(spark, rows, schema, retry, [rows[:5], rows[5:]], "retry")
    assert sorted(streamed, key=str) == sorted((tuple(r) for r in retry(spark.createDataFrame(rows, schema)).collect()), key=str)


def card(name: str, cpf: str) -> list:
    texts = ["MINISTÉRIO DA FAZENDA", "CADASTRO DE PESSOAS FÍSICAS", "NÚMERO DE INSCRIÇÃO", cpf, "NOME", name, "NASCIMENTO", "14/03/1985"]
    blocks = [{"text": t, "confidence": 0.9, "boundingBox": [50, 30 * n, 250, 30 * n, 250, 30 * n + 20, 50, 30 * n + 20]} for n, t in enumerate(texts)]
    return [{"page": 1, "imageWidth": 1000, "imageHeight": 1400, "durationMs": 5, "blocks": blocks}]


def test_incremental_processing_equals_batch_and_replaces(spark):
    source, target, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    profile = profile_json({"title": ("0.50", ["CADASTRO DE PESSOAS FISICAS"]), "number": ("0.20", ["NUMERO DE INSCRICAO"])})
    rules = load_rules(spark.createDataFrame([("BR_CPF_CARD", 0, True, profile)], "document_type string, position int, active boolean, rules_json string"))[0]

    def arrive(name, doc_id, attempt, pages):
        with open(f"{source}/{name}.json", "w") as out:
            json.dump({"doc_id": doc_id, "attempt": attempt, "source": "s", "modelVersion": "m", "pages": pages}, out)

    arrive("a", 1, 1, card("MARIA DA SILVA", "529.982.247-25"))
    arrive("b", 2, 1, card("ANA SOUZA", "111.444.777-36"))
    incremental.run_incremental(spark, source, target, checkpoint, rules, date(2024, 6, 1))
    first = {(r["doc_id"], r["path"]): (r["status"], r["normalized"]) for r in incremental.published(spark, target).collect()}
    assert first[(1, "cpf")] == ("VALID", "52998224725") and first[(2, "cpf")] == ("INVALID", None) and first[(1, "birthDate")] == ("VALID", "1985-03-14")
    # Two attempts in one batch, of which the last one counts, and a last attempt that is of no known class.
    arrive("c", 2, 2, card("ANA SOUZA", "111.444.777-35"))
    arrive("d", 2, 3, card("ANA LIMA", "529.982.247-25"))
    arrive("e", 1, 2, [{"page": 1, "imageWidth": 9, "imageHeight": 9, "durationMs": 5, "blocks": [{"text": "nada", "confidence": 0.9, "boundingBox": [0, 0, 9, 0, 9, 9, 0, 9]}]}])
    incremental.run_incremental(spark, source, target, checkpoint, rules, date(2024, 6, 1))
    stored = spark.read.parquet(f"{target}/fields").filter("doc_id = 2 AND path IN ('cpf', 'name')").select("attempt", "path", "normalized").collect()
    assert sorted(tuple(r) for r in stored) == [(1, "cpf", None), (1, "name", "ANA SOUZA"), (2, "cpf", "11144477735"), (2, "name", "ANA SOUZA"), (3, "cpf", "52998224725"), (3, "name", "ANA LIMA")]
    again = {(r["doc_id"], r["path"]): (r["status"], r["normalized"]) for r in incremental.published(spark, target).collect()}
    assert again[(2, "cpf")] == ("VALID", "52998224725") and not any(doc == 1 for doc, _ in again)
    attempts = {(r["doc_id"], r["attempt"]): r["document_type"] for r in incremental.current_attempts(spark, target).collect()}
    assert attempts == {(1, 2): "UNKNOWN", (2, 3): "BR_CPF_CARD"}


def test_store_replaces_batches_and_compacts(spark):
    target = tempfile.mkdtemp(prefix="spark-")

    def batch(number, rows):
        fields = spark.createDataFrame([(d, a, "p", v) for d, a, v in rows if v is not None], "doc_id long, attempt int, path string, normalized string")
        attempts = spark.createDataFrame([(d, a, "T" if v else "UNKNOWN") for d, a, v in rows], "doc_id long, attempt int, document_type string")
        incremental.publish(fields, attempts, number, target)

    def state():
        return sorted((r["doc_id"], r["attempt"], r["normalized"]) for r in incremental.published(spark, target).collect())

    batch(0, [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")])
    batch(1, [(1, 2, "d"), (2, 2, None)])
    batch(1, [(1, 2, "e"), (2, 2, None)])  # the same batch again
    assert state() == [(1, 2, "e"), (3, 1, "c")]
    assert incremental.compact(spark, target) == 1 and state() == [(1, 2, "e"), (3, 1, "c")]
    batch(2, [(3, 1, "again"), (2, 3, "f")])  # an attempt told twice: the later batch counts
    batch(3, [(1, 3, None)])
    assert state() == [(2, 3, "f"), (3, 1, "again")]
    assert incremental.compact(spark, target) == 3 and incremental.compact(spark, target) == 3 and state() == [(2, 3, "f"), (3, 1, "again")]


def test_replay_guard_over_long_logs(spark):
    """Openings of keys with gaps, ties and live records, against a walk through the log; as many jobs for ten years as for ten days, but for the rounds."""
    import random

    rnd = random.Random(3)
    rows = [(rnd.choice("abcd"), n, rnd.choice("xy"), START + timedelta(hours=rnd.choice([rnd.randint(0, 90), rnd.randint(0, 9000), 24 * rnd.randint(0, 9)]))) for n in range(400)]
    live = [("a", START - timedelta(hours=20), -1, "x"), ("c", START - timedelta(hours=30), -2, "y")]
    schema = "key string, upload_id bigint, digest string, uploaded_at timestamp_ntz"
    held, want = {k: (at, by, digest) for k, at, by, digest in live}, {}
    for key, n, digest, at in sorted(rows, key=lambda r: (r[3], r[1])):
        record = held.get(key)
        if record is None or at >= record[0] + timedelta(hours=24):
            held[key] = record = (at, n, digest)
        want[n] = ("NEW" if record[1] == n else "REPLAY" if record[2] == digest else "CONFLICT", record[1])
    uploads = spark.createDataFrame(rows, schema)
    old = spark.createDataFrame(live, "key string, opened_at timestamp_ntz, opened_by bigint, opened_digest string")
    assert {r["upload_id"]: (r["outcome"], r["answered_by"]) for r in intake.replay_guard(uploads, live=old).collect()} == want
    assert intake.replay_guard(uploads.limit(0)).count() == 0


def test_replay_state_is_cleared_after_its_life(spark):
    folder, checkpoint = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    schema = "key string, upload_id bigint, digest string, uploaded_at timestamp"
    rows = [("a", 1, "x", START), ("b", 2, "x", START + timedelta(hours=30)), ("c", 3, "x", START + timedelta(hours=80)), ("c", 4, "x", START + timedelta(hours=81))]
    states.use_rocksdb(spark)
    for number, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(f"{folder}/part={number:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/part=*")
    query = states.replay_stream(stream).writeStream.format("memory").queryName("cleared").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "record").load(checkpoint)
    assert [r["key"]["key"] for r in left.select("key").collect()] == ["c"]
    assert sorted(tuple(r) for r in spark.table("cleared").collect()) == [(1, "NEW", 1), (2, "NEW", 2), (3, "NEW", 3), (4, "REPLAY", 3)]
