"""Timeline, retention, purge, erasure, relocation and notification queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cartorio.gallery import archive as a
from cartorio.gallery.base import NOW, NOW_SQL, query
from cartorio.operators import intake, lifecycle as ops, notices

D, P, PO = a.DOCS, a.PRODUCTS_SQL, a.POLICIES_SQL


@query(
    "timeline",
    f"WITH {a.LOG}, t AS (SELECT DISTINCT doc_id, occurred_at, stage, details FROM log) "
    f"SELECT doc_id, stage, CAST(occurred_at AS VARCHAR) AS occurred_at, details, row_number() OVER (PARTITION BY doc_id ORDER BY occurred_at, {a.RANK_SQL}, details) AS position FROM t",
)
def timeline(t):
    rows = a.log(t).select("doc_id", "occurred_at", "stage", "details").distinct()
    hour = {"hour": F.col("occurred_at")}
    ordered = ops.ordered_positions(rows, ["doc_id"], hour, ["occurred_at", ops.stage_rank(F.col("stage")), "details"])
    return ordered.select("doc_id", "stage", a.text_of("occurred_at"), "details", "position")


@query(
    "timeline_details",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
)
def timeline_details(t):
    """Key=value event texts parsed back into columns."""
    parsed = ops.parse_details(a.log(t))
    got = lambda k: F.try_element_at("detail", F.lit(k))
    return parsed.groupBy(got("k").cast("bigint").alias("k"), got("kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "lifecycle_fold",
    f"WITH {a.LOG} SELECT doc_id, stage AS status, CAST(occurred_at AS VARCHAR) AS since, events FROM "
    f"(SELECT *, count(*) OVER (PARTITION BY doc_id) AS events, row_number() OVER (PARTITION BY doc_id ORDER BY occurred_at DESC, {a.RANK_SQL} DESC) AS rn FROM log) WHERE rn = 1",
)
def lifecycle_fold(t):
    return ops.lifecycle_fold(a.log(t)).select("doc_id", "status", a.text_of("since"), "events")


@query(
    "illegal_transitions",
    f"WITH {a.LOG}, t AS (SELECT DISTINCT doc_id, occurred_at, stage FROM log), "
    f"p AS (SELECT *, lag(stage) OVER (PARTITION BY doc_id ORDER BY occurred_at, {a.RANK_SQL}) AS previous FROM t) "
    "SELECT previous, stage, count(*) AS n FROM p WHERE previous IS NOT NULL AND previous <> stage AND NOT ("
    "(stage = 'QUEUED' AND previous IN ('STORED','FAILED','COMPLETED','QUEUED','PREPROCESSING','OCR_RUNNING','CLASSIFYING','EXTRACTING')) OR "
    "(stage IN ('OCR_RUNNING','EXTRACTING','COMPLETED','FAILED') AND previous IN ('QUEUED','PREPROCESSING','OCR_RUNNING','CLASSIFYING','EXTRACTING'))) GROUP BY 1, 2",
)
def illegal_transitions(t):
    rows = a.log(t).select("doc_id", "occurred_at", "stage").distinct()
    return ops.illegal_transitions(rows).groupBy("previous", "stage").agg(F.count(F.lit(1)).alias("n"))


@query(
    "migration_history",
    "SELECT user_id AS doc_id, count(*) AS moves FROM events WHERE event_type = 'view' AND event_id % 3 <> 0 GROUP BY 1",
)
def migration_history(t):
    """Moves that name both ends; a spoiled id drops the entry."""
    uuid = F.format_string("%08d-0000-4000-8000-000000000000", F.col("event_id"))
    spoiled = F.when(F.col("event_id") % 3 == 0, F.lit("nowhere")).otherwise(uuid)
    moves = t.events.filter("event_type = 'view'").select(
        F.col("user_id").alias("doc_id"),
        F.lit(ops.MIGRATED).alias("event_type"),
        F.concat(F.lit("fromRepositoryId="), uuid, F.lit(" toRepositoryId="), spoiled).alias("details"),
    )
    return ops.migration_history(moves).groupBy("doc_id").agg(F.count(F.lit(1)).alias("moves"))


@query(
    "reprocess_outcomes",
    f"WITH {D}, requests AS (SELECT event_id AS request_id, event_id AS doc_id, ts AS requested_at FROM events "
    "UNION ALL SELECT event_id + 1000000, event_id, ts + INTERVAL 1 DAY FROM events WHERE event_id % 4 = 0), "
    "busy AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_linestatus = 'O'), "
    "j AS (SELECT r.*, d.status, b.doc_id IS NOT NULL AS busy, row_number() OVER (PARTITION BY r.doc_id ORDER BY requested_at, request_id) AS turn FROM requests r LEFT JOIN docs d USING (doc_id) LEFT JOIN busy b USING (doc_id)) "
    "SELECT request_id, doc_id, CASE WHEN status IS NULL THEN 'NOT_FOUND' WHEN status = 'PURGED' THEN 'PURGED' WHEN busy OR status NOT IN ('STORED','FAILED','COMPLETED') OR turn > 1 THEN 'CONFLICT' ELSE 'QUEUED' END AS outcome FROM j",
)
def reprocess_outcomes(t):
    docs = a.documents(t)
    first = t.events.selectExpr("event_id AS request_id", "event_id AS doc_id", "ts AS requested_at")
    again = t.events.filter("event_id % 4 = 0").selectExpr("event_id + 1000000 AS request_id", "event_id AS doc_id", "ts + INTERVAL 1 DAY AS requested_at")
    jobs = t.lineitem.selectExpr("l_orderkey AS doc_id", "CASE WHEN l_linestatus = 'O' THEN 'RUNNING' ELSE 'DONE' END AS status")
    return ops.reprocess_outcomes(first.unionByName(again), docs, jobs).select("request_id", "doc_id", "outcome")


_RESOLVED = (
    "typed AS (SELECT *, CASE WHEN trim({type}) IN ('', 'UNKNOWN') THEN NULL ELSE trim({type}) END AS scope_type FROM docs), "
    "resolved AS (SELECT doc_id, (SELECT min_by(o, CASE WHEN o.document_type IS NOT NULL AND o.product_id IS NOT NULL THEN 0 WHEN o.product_id IS NOT NULL THEN 1 WHEN o.document_type IS NOT NULL THEN 2 ELSE 3 END) "
    "FROM policies o WHERE (o.document_type IS NULL OR o.document_type = t.scope_type) AND (o.product_id IS NULL OR o.product_id = t.product_id)) AS p FROM typed t)"
)
RESOLVED = _RESOLVED.format(type="detected_type")


@query("retention_resolve", f"WITH {D}, {PO}, {RESOLVED} SELECT doc_id, p.policy_id AS policy_id, p.days AS retention_days FROM resolved")
def retention_resolve(t):
    docs = a.documents(t).drop("policy_id", "retention_days")
    return ops.resolve_retention(docs, a.policies(t), "detected_type").select("doc_id", "policy_id", "retention_days")


@query(
    "retention_apply",
    f"WITH {D}, {PO}, {RESOLVED} SELECT d.doc_id, p.policy_id AS policy_id, CAST(d.uploaded_at + to_days(p.days) AS VARCHAR) AS expires_at FROM docs d JOIN resolved USING (doc_id)",
)
def retention_apply(t):
    docs = a.documents(t).drop("policy_id", "retention_days", "expires_at").withColumnRenamed("detected_type", "document_type")
    return ops.apply_retention(docs, a.policies(t)).select("doc_id", "policy_id", a.text_of("expires_at"))


@query(
    "retention_switch",
    f"WITH {D}, {PO}, {RESOLVED}, s AS (SELECT d.*, p, p.policy_id IS DISTINCT FROM d.policy_id AS switched, coalesce(d.expires_at - to_days(d.retention_days), d.uploaded_at) AS basis FROM docs d JOIN resolved USING (doc_id)) "
    "SELECT doc_id, switched, CASE WHEN switched THEN p.policy_id ELSE policy_id END AS policy_id, CAST(CASE WHEN switched THEN basis + to_days(p.days) ELSE expires_at END AS VARCHAR) AS expires_at FROM s",
)
def retention_switch(t):
    switched = ops.switch_policy_on_type(a.documents(t), a.policies(t))
    return switched.select("doc_id", "switched", "policy_id", a.text_of("expires_at"))


@query(
    "retention_reapply",
    f"WITH {D}, {PO}, s AS (SELECT d.*, o.days, o.days IS NOT NULL AND d.retention_days IS DISTINCT FROM o.days AS changed FROM docs d LEFT JOIN policies o USING (policy_id)) "
    "SELECT doc_id, CAST(CASE WHEN changed THEN days ELSE retention_days END AS INTEGER) AS retention_days, CAST(CASE WHEN changed THEN coalesce(expires_at - to_days(retention_days), uploaded_at) + to_days(days) ELSE expires_at END AS VARCHAR) AS expires_at, "
    "CASE WHEN changed THEN 'policyId=' || policy_id || ' retentionDays=' || days END AS details FROM s",
)
def retention_reapply(t):
    docs, events = ops.reapply_policy(a.documents(t), a.policies(t), NOW)
    told = docs.join(events.select("doc_id", "details"), "doc_id", "left")
    return told.select("doc_id", "retention_days", a.text_of("expires_at"), "details")


@query(
    "retention_backfill",
    f"WITH {D} SELECT doc_id, CASE WHEN expires_at IS NULL THEN 'G' ELSE policy_id END AS policy_id, CAST(CASE WHEN expires_at IS NULL THEN uploaded_at + INTERVAL 365 DAY ELSE expires_at END AS VARCHAR) AS expires_at FROM docs",
)
def retention_backfill(t):
    return ops.backfill_retention(a.documents(t), a.policies(t)).select("doc_id", "policy_id", a.text_of("expires_at"))


PURGEABLE = f"due AS (SELECT * FROM docs WHERE expires_at <= {NOW_SQL} AND status IN ('COMPLETED', 'FAILED', 'REJECTED'))"
DELETED = (
    "deleted AS (SELECT due.doc_id, 'file' || CASE WHEN count(e.extraction_id) > 0 THEN ',ocr_text' ELSE '' END || CASE WHEN coalesce(bool_or(e.structured IS NOT NULL OR e.extraction_id IN (SELECT extraction_id FROM fields)), false) THEN ',extracted_fields' ELSE '' END AS deleted "
    "FROM due LEFT JOIN extractions e USING (doc_id) GROUP BY due.doc_id)"
)


@query("purge_batch", f"WITH {D}, {PURGEABLE} SELECT doc_id, CAST(expires_at AS VARCHAR) AS expires_at FROM due ORDER BY due.expires_at, doc_id LIMIT 50")
def purge_batch(t):
    from cartorio.operators.listing import oldest_due

    return oldest_due(ops.purgeable(a.documents(t), NOW), "expires_at", "doc_id", 50).select("doc_id", a.text_of("expires_at"))


@query("purge_contents", f"WITH {D}, {a.EXTRACTIONS}, {a.FIELDS}, {PURGEABLE}, {DELETED} SELECT doc_id, deleted FROM deleted")
def purge_contents(t):
    targets = ops.purgeable(a.documents(t), NOW).select("doc_id")
    return ops.purge_contents(targets, a.extractions(t), a.fields(t)).select("doc_id", F.array_join("deleted", ",").alias("deleted"))


@query(
    "purge_apply",
    f"WITH {D}, {a.EXTRACTIONS}, {a.FIELDS}, {PURGEABLE}, {DELETED}, left_over AS (SELECT * FROM extractions WHERE doc_id NOT IN (SELECT doc_id FROM due)) "
    "SELECT 'documents' AS part, count(*) AS total, CAST(count(*) FILTER (doc_id IN (SELECT doc_id FROM due) OR status = 'PURGED') AS BIGINT) AS marked, NULL AS sample FROM docs "
    "UNION ALL SELECT 'extractions', count(*), CAST(sum(extraction_id) AS BIGINT), NULL FROM left_over "
    "UNION ALL SELECT 'fields', count(*), CAST(sum(extraction_id) AS BIGINT), NULL FROM fields WHERE extraction_id IN (SELECT extraction_id FROM left_over) "
    "UNION ALL SELECT 'events', count(*), CAST(sum(doc_id) AS BIGINT), max('reason=RETENTION_EXPIRED deleted=' || deleted) FROM deleted",
)
def purge_apply(t):
    """The four snapshots after a purge, summed up."""
    after = ops.purge(a.documents(t), a.extractions(t), a.fields(t), NOW)
    none = F.lit(None).cast("string")
    part = lambda name, df, marked, sample=none: df.agg(
        F.lit(name).alias("part"), F.count(F.lit(1)).alias("total"), marked.cast("bigint").alias("marked"), F.max(sample).alias("sample")
    )
    return (
        part("documents", after["documents"], F.count_if(F.col("status") == "PURGED"))
        .unionByName(part("extractions", after["extractions"], F.sum("extraction_id")))
        .unionByName(part("fields", after["fields"], F.sum("extraction_id")))
        .unionByName(part("events", after["events"], F.sum("doc_id"), F.col("details")))
    )


@query(
    "orphan_cleanup",
    f"WITH {D}, {a.EXTRACTIONS} SELECT count(*) AS kept, CAST(sum(extraction_id) AS BIGINT) AS checksum FROM extractions WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE status = 'PURGED')",
)
def orphan_cleanup(t):
    kept = ops.drop_orphans(a.extractions(t), a.documents(t))
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.sum("extraction_id").alias("checksum"))


# ---------------------------------------------------------------- erasure

ERASE_NOW = datetime(2024, 1, 15, 12)
ERASE_NOW_SQL = "TIMESTAMP '2024-01-15 12:00:00'"
REQUESTS = (
    "requests AS (SELECT event_id AS request_id, event_id % 2000 AS doc_id, ts AS requested_at, CASE event_type WHEN 'error' THEN 'REJECTED' WHEN 'view' THEN 'APPROVED' ELSE 'PENDING' END AS status, "
    "CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'admin' END AS approved_by FROM events)"
)


def _requests(t):
    return t.events.selectExpr(
        "event_id AS request_id",
        "event_id % 2000 AS doc_id",
        "ts AS requested_at",
        "CASE event_type WHEN 'error' THEN 'REJECTED' WHEN 'view' THEN 'APPROVED' ELSE 'PENDING' END AS status",
        "CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'admin' END AS approved_by",
        "CAST(NULL AS TIMESTAMP_NTZ) AS decided_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS executed_at",
    )


@query(
    "erasure_gate",
    f"WITH {D}, {P}, {REQUESTS} SELECT r.request_id, r.doc_id, CASE WHEN d.doc_id IS NULL THEN 'DOCUMENT_NOT_FOUND' WHEN p.active THEN 'DOCUMENT_IN_USE_BY_PRODUCT_SERVICE' WHEN d.expires_at > {NOW_SQL} THEN 'RETENTION_NOT_EXPIRED' ELSE 'PENDING' END AS outcome "
    "FROM requests r LEFT JOIN docs d USING (doc_id) LEFT JOIN products p ON d.product_id = p.product_id",
)
def erasure_gate(t):
    return ops.gate_erasure(_requests(t).select("request_id", "doc_id"), a.documents(t), a.products(t), NOW)


@query(
    "auto_approve",
    f"WITH {REQUESTS} SELECT request_id, CASE WHEN status = 'PENDING' AND requested_at <= {ERASE_NOW_SQL} - INTERVAL 24 HOUR THEN 'APPROVED' ELSE status END AS status, "
    f"CASE WHEN status = 'PENDING' AND requested_at <= {ERASE_NOW_SQL} - INTERVAL 24 HOUR THEN 'system:auto-approve-24h' ELSE approved_by END AS approved_by FROM requests",
)
def auto_approve(t):
    return ops.auto_approve(_requests(t), ERASE_NOW).select("request_id", "status", "approved_by")


@query(
    "approved_erasures",
    f"WITH {D}, {REQUESTS} SELECT r.request_id, r.doc_id, d.repository_id, d.storage_key FROM requests r JOIN docs d USING (doc_id) WHERE r.status = 'APPROVED'",
)
def approved_erasures(t):
    return ops.approved_erasures(_requests(t), a.documents(t)).select("request_id", "doc_id", "repository_id", "storage_key")


@query(
    "erasure_decide",
    f"WITH {REQUESTS} SELECT request_id, CASE WHEN status = 'PENDING' THEN CASE WHEN request_id % 10 = 0 THEN 'REJECTED' ELSE 'APPROVED' END ELSE status END AS status, CASE WHEN status = 'PENDING' THEN 'user' || CAST(doc_id % 7 AS VARCHAR) ELSE approved_by END AS approved_by FROM requests",
)
def erasure_decide(t):
    decisions = _requests(t).selectExpr("request_id", "CASE WHEN request_id % 10 = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS decision", "concat('user', CAST(doc_id % 7 AS STRING)) AS decided_by")
    return ops.decide(_requests(t), decisions, ERASE_NOW).select("request_id", "status", "approved_by")


@query(
    "erasure_execute",
    f"WITH {D}, {a.EXTRACTIONS}, {REQUESTS}, ok AS (SELECT r.* FROM requests r JOIN docs d USING (doc_id) WHERE r.status = 'APPROVED'), gone AS (SELECT doc_id, min_by(request_id, (requested_at, request_id)) AS request_id FROM ok WHERE doc_id IN (SELECT doc_id FROM docs WHERE status <> 'PURGED') GROUP BY doc_id) "
    "SELECT 'documents' AS part, count(*) AS total, CAST(sum(doc_id) AS BIGINT) AS checksum FROM docs WHERE status = 'PURGED' OR doc_id IN (SELECT doc_id FROM gone) "
    "UNION ALL SELECT 'requests', count(*), CAST(sum(request_id) AS BIGINT) FROM ok "
    "UNION ALL SELECT 'events', count(*), CAST(sum(request_id) AS BIGINT) FROM gone "
    "UNION ALL SELECT 'audit', count(*), CAST(count(*) FILTER (approved_by IS NULL) AS BIGINT) FROM ok "
    "UNION ALL SELECT 'extractions', count(*), CAST(sum(extraction_id) AS BIGINT) FROM extractions WHERE doc_id NOT IN (SELECT doc_id FROM gone)",
)
def erasure_execute(t):
    after = ops.execute_erasures(_requests(t), a.documents(t), a.extractions(t), a.fields(t), ERASE_NOW)
    part = lambda name, df, check: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("total"), check.cast("bigint").alias("checksum"))
    request = F.regexp_extract("details", "requestId=([0-9]+) ", 1).cast("bigint")
    return (
        part("documents", after["documents"].filter("status = 'PURGED'"), F.sum("doc_id"))
        .unionByName(part("requests", after["requests"].filter("status = 'EXECUTED'"), F.sum("request_id")))
        .unionByName(part("events", after["events"], F.sum(request)))
        .unionByName(part("audit", after["audit"], F.count_if(F.col("changes").endswith("approvedBy=unknown"))))
        .unionByName(part("extractions", after["extractions"], F.sum("extraction_id")))
    )


# ---------------------------------------------------------------- relocation

MOVES = (
    f"moves AS (SELECT o_orderkey AS doc_id, 'fromRepositoryId=R1 toRepositoryId=R2 migrationJobId=' || CASE WHEN o_orderkey % 10 = 1 THEN '{a.JOB}' ELSE '{a.OTHER_JOB}' END AS details FROM orders)"
)


def _moves(t):
    return t.orders.selectExpr(
        "o_orderkey AS doc_id",
        f"'{ops.MIGRATED}' AS event_type",
        f"concat('fromRepositoryId=R1 toRepositoryId=R2 migrationJobId=', CASE WHEN o_orderkey % 10 = 1 THEN '{a.JOB}' ELSE '{a.OTHER_JOB}' END) AS details",
    )


ELIGIBLE = f"eligible AS (SELECT * FROM docs WHERE repository_id = 'R1' AND status <> 'PURGED' AND uploaded_at >= TIMESTAMP '1996-01-01' AND doc_id NOT IN (SELECT doc_id FROM moves WHERE details LIKE '%migrationJobId={a.JOB}%'))"


@query("migration_eligible", f"WITH {D}, {MOVES}, {ELIGIBLE} SELECT doc_id, status FROM eligible")
def migration_eligible(t):
    eligible = ops.migration_eligible(a.documents(t), _moves(t), a.JOB, "R1", uploaded_from=datetime(1996, 1, 1))
    return eligible.select("doc_id", "status")


@query(
    "migration_apply",
    f"WITH {D}, {MOVES}, {ELIGIBLE} SELECT d.doc_id, CASE WHEN e.doc_id IS NULL THEN d.repository_id ELSE 'R3' END AS repository_id, CASE WHEN e.doc_id IS NOT NULL THEN 'fromRepositoryId=R1 toRepositoryId=R3 migrationJobId={a.JOB}' END AS details "
    "FROM docs d LEFT JOIN eligible e USING (doc_id)",
)
def migration_apply(t):
    docs = a.documents(t)
    eligible = ops.migration_eligible(docs, _moves(t), a.JOB, "R1", uploaded_from=datetime(1996, 1, 1))
    moved, events = ops.migrate_locations(docs, eligible, a.JOB, "R3", NOW)
    return moved.select("doc_id", "repository_id").join(events.select("doc_id", "details"), "doc_id", "left")


# ---------------------------------------------------------------- notifications


@query(
    "fan_out",
    f"WITH {D}, {P}, {a.SUBSCRIPTIONS_SQL}, told AS (SELECT *, CASE status WHEN 'COMPLETED' THEN 'document.completed' WHEN 'FAILED' THEN 'document.failed' WHEN 'PURGED' THEN 'document.purged' END AS event FROM docs) "
    "SELECT t.doc_id, s.subscription_id, t.event, '{\"event\":\"' || t.event || '\",\"documentId\":' || t.doc_id || ',\"protocol\":\"k/' || t.doc_id || '\",\"status\":\"' || t.status || '\",\"detectedDocumentType\":' || coalesce('\"' || detected_type || '\"', 'null') || ',\"productServiceCode\":' || coalesce('\"' || p.code || '\"', 'null') || ',\"occurredAt\":\"' || strftime(t.uploaded_at, '%Y-%m-%dT%H:%M:%S.000Z') || '\"}' AS payload "
    "FROM told t JOIN subscriptions s ON s.active AND list_contains(s.events, t.event) AND (s.product_id IS NULL OR s.product_id = t.product_id) LEFT JOIN products p ON p.product_id = t.product_id",
)
def fan_out(t):
    changes = a.documents(t).join(a.products(t).select("product_id", F.col("code").alias("product_code")), "product_id", "left")
    changes = changes.withColumns({"protocol": F.col("storage_key"), "occurred_at": F.col("uploaded_at")})
    return notices.fan_out(changes, a.subscriptions(t)).select("doc_id", "subscription_id", "event", "payload")


ATTEMPTS = "attempts AS (SELECT event_id, user_id, event_type, ts, CAST(event_id % 5 + 1 AS INTEGER) AS attempt FROM events)"


@query(
    "retry_plan",
    f"WITH {ATTEMPTS} SELECT event_id, CASE WHEN event_type <> 'click' AND attempt < 3 THEN 'PENDING' ELSE 'FAILED' END AS job_status, "
    "CASE WHEN event_type <> 'click' AND attempt < 3 THEN strftime(ts + to_seconds(CAST(least(15 * 2 ** (attempt - 1), 300) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') END AS available_at FROM attempts",
)
def retry_plan(t):
    failures = t.events.select(
        "event_id", (F.col("event_type") != "click").alias("transient"), (F.col("event_id") % 5 + 1).cast("int").alias("attempt"), F.col("ts").alias("failed_at")
    )
    planned = notices.retry_plan(failures)
    return planned.select("event_id", "job_status", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("available_at"))


@query(
    "delivery_plan",
    f"WITH {ATTEMPTS}, s AS (SELECT *, user_id % 9 <> 0 AS active, event_type = 'purchase' AS success, CASE attempt WHEN 1 THEN 10 WHEN 2 THEN 30 WHEN 3 THEN 90 END AS delay FROM attempts) "
    "SELECT event_id, CASE WHEN NOT active THEN 'CANCELLED' WHEN success THEN 'SUCCEEDED' WHEN delay IS NOT NULL THEN 'PENDING' ELSE 'FAILED' END AS delivery_status, "
    "CASE WHEN active AND NOT success AND delay IS NOT NULL THEN strftime(ts + to_seconds(delay), '%Y-%m-%d %H:%M:%S.%f') END AS next_attempt_at, CASE WHEN active AND NOT success AND delay IS NULL THEN 'WEBHOOK_DELIVERY_FAILED' END AS event_type FROM s",
)
def delivery_plan(t):
    attempts = t.events.select(
        "event_id",
        (F.col("user_id") % 9 != 0).alias("subscription_active"),
        (F.col("event_type") == "purchase").alias("success"),
        (F.col("event_id") % 5 + 1).cast("int").alias("attempt"),
        F.col("ts").alias("attempted_at"),
    )
    planned = notices.delivery_plan(attempts)
    return planned.select("event_id", "delivery_status", F.date_format("next_attempt_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("next_attempt_at"), "event_type")


@query(
    "stuck_work",
    "WITH beats AS (SELECT user_id AS job_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS rn FROM events WHERE ts < TIMESTAMP '2024-01-20') "
    "SELECT job_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS last_seen_at, 'STUCK_JOB_RECOVERED' AS details FROM beats WHERE rn = 1 AND event_type IN ('view', 'click', 'signup') AND ts < TIMESTAMP '2024-01-20' - INTERVAL 5 MINUTE",
)
def stuck_work(t):
    beats = t.events.filter(F.col("ts") < F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")).select(
        F.col("user_id").alias("job_id"), F.col("user_id").alias("doc_id"), F.col("ts").alias("seen_at"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "RUNNING").otherwise("DONE").alias("status"),
    )
    found = notices.stuck_work(beats, datetime(2024, 1, 20))
    return found.select("job_id", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen_at"), "details")


REPLAY_SQL = """
WITH RECURSIVE uploads AS (SELECT source || '-' || CAST(doc_id % 3 AS VARCHAR) AS key, doc_id AS upload_id, sha256(CAST(doc_id % 2 AS VARCHAR)) AS digest,
  TIMESTAMP '2024-03-01' + to_seconds(CAST((doc_id * 7919) % 345600 AS BIGINT)) AS uploaded_at FROM documents),
u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY uploaded_at, upload_id) AS rn FROM uploads),
walk AS (SELECT key, upload_id, digest, uploaded_at, rn, uploaded_at AS opened_at, upload_id AS answered_by, digest AS opened_digest FROM u WHERE rn = 1
  UNION ALL SELECT u.key, u.upload_id, u.digest, u.uploaded_at, u.rn,
    CASE WHEN u.uploaded_at >= w.opened_at + INTERVAL 24 HOUR THEN u.uploaded_at ELSE w.opened_at END,
    CASE WHEN u.uploaded_at >= w.opened_at + INTERVAL 24 HOUR THEN u.upload_id ELSE w.answered_by END,
    CASE WHEN u.uploaded_at >= w.opened_at + INTERVAL 24 HOUR THEN u.digest ELSE w.opened_digest END
  FROM walk w JOIN u ON u.key = w.key AND u.rn = w.rn + 1)
SELECT upload_id, answered_by, CASE WHEN upload_id = answered_by THEN 'NEW' WHEN digest = opened_digest THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM walk
"""


def uploads(t):
    return t.documents.selectExpr(
        "concat(source, '-', CAST(doc_id % 3 AS STRING)) AS key",
        "doc_id AS upload_id",
        "sha2(CAST(doc_id % 2 AS STRING), 256) AS digest",
        "TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, (doc_id * 7919) % 345600) AS uploaded_at",
    )


@query("replay_guard", REPLAY_SQL)
def replay_guard(t):
    return intake.replay_guard(uploads(t)).select("upload_id", "answered_by", "outcome")
