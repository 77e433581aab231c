"""Status timeline, retention, purge, erasure and relocation as whole-set snapshot transforms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.bounds import hint_small
from cartorio.functions.expressions import all_of, at_rank, bind, equals_if, first_case
from cartorio.operators.ordering import ordered_positions, with_previous

# Statuses in lifecycle order.
STATUSES = (
    "RECEIVED", "STORED", "QUEUED", "PREPROCESSING", "OCR_RUNNING", "CLASSIFYING", "EXTRACTING",
    "COMPLETED", "FAILED", "REJECTED", "PURGED",
)
RUNNING = ("QUEUED", "PREPROCESSING", "OCR_RUNNING", "CLASSIFYING", "EXTRACTING")
PURGEABLE = ("COMPLETED", "FAILED", "REJECTED")
REPROCESSABLE = ("STORED", "FAILED", "COMPLETED")
ACTIVE_JOB = ("PENDING", "RUNNING")

# From which status a document may reach another one.
ALLOWED_FROM = {
    "RECEIVED": (),
    "STORED": ("RECEIVED",),
    "QUEUED": ("STORED", "FAILED", "COMPLETED", *RUNNING),
    "PREPROCESSING": RUNNING,
    "OCR_RUNNING": RUNNING,
    "CLASSIFYING": RUNNING,
    "EXTRACTING": RUNNING,
    "COMPLETED": RUNNING,
    "FAILED": RUNNING,
    "REJECTED": ("RECEIVED",),
    "PURGED": PURGEABLE,
}

MIGRATED = "STORAGE_MIGRATED"
EVENT_COLUMNS = ("doc_id", "event_type", "stage", "details", "occurred_at")


def stage_rank(stage: Column) -> Column:
    return at_rank(stage, STATUSES)


# ---------------------------------------------------------------- timeline


def timeline(events: DataFrame) -> DataFrame:
    """Events with their position per document: by time, ties by lifecycle order."""
    hour = {"hour": F.date_trunc("hour", F.col("occurred_at"))}
    return ordered_positions(events, ["doc_id"], hour, ["occurred_at", stage_rank(F.col("stage"))])


def timeline_arrays(events: DataFrame) -> DataFrame:
    """One row per document with its ordered entries."""
    entry = F.struct("occurred_at", stage_rank(F.col("stage")).alias("rank"), "event_type", "stage", "details")
    return events.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("timeline"))


UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z"


def parse_details(df: DataFrame, details: str = "details") -> DataFrame:
    """``a=1 b=2`` texts as a map column (later keys win)."""
    tokens = F.filter(F.split(F.coalesce(F.col(details), F.lit("")), " "), lambda t: F.instr(t, "=") > 1)
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substr(t, F.instr(t, "=") + 1).alias("v")))
    latest = bind(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])))
    return df.withColumn("detail", F.map_from_entries(latest))


def migration_history(events: DataFrame) -> DataFrame:
    """Moves whose event names both ends by a well-formed id."""
    parsed = parse_details(events.filter(F.col("event_type") == MIGRATED))
    ends = parsed.withColumn("from_repository", F.try_element_at("detail", F.lit("fromRepositoryId"))).withColumn(
        "to_repository", F.try_element_at("detail", F.lit("toRepositoryId"))
    )
    return ends.filter(F.col("from_repository").rlike(UUID) & F.col("to_repository").rlike(UUID)).drop("detail")


def lifecycle_fold(events: DataFrame) -> DataFrame:
    """Current status per document from its log: the newest entry, ties by lifecycle order."""
    newest = F.max(F.struct("occurred_at", stage_rank(F.col("stage")).alias("rank"), "stage"))
    folded = events.groupBy("doc_id").agg(newest.alias("last"), F.count(F.lit(1)).alias("events"))
    return folded.select("doc_id", F.col("last.stage").alias("status"), F.col("last.occurred_at").alias("since"), "events")


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Entries that follow a status from which their own cannot be reached."""
    pairs = with_previous(timeline(events), "doc_id", "stage", "previous")
    allowed = first_case(
        [(F.col("stage") == to, F.col("previous").isin(*sources) if sources else F.lit(False)) for to, sources in ALLOWED_FROM.items()],
        F.lit(False),
    )
    stays = F.col("stage") == F.col("previous")
    return pairs.filter(F.col("previous").isNotNull() & ~stays & ~allowed)


# ---------------------------------------------------------------- reprocessing


def reprocess_outcomes(requests: DataFrame, docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """NOT_FOUND, PURGED, CONFLICT or QUEUED per request; at most one request per document is queued."""
    active = jobs.filter(F.col("status").isin(*ACTIVE_JOB)).select("doc_id").distinct().withColumn("busy", F.lit(True))
    turn = F.struct("requested_at", "request_id")
    firsts = requests.groupBy("doc_id").agg(F.min(turn).alias("first"))
    joined = requests.join(docs.select("doc_id", "status"), "doc_id", "left").join(active, "doc_id", "left").join(firsts, "doc_id", "left")
    outcome = first_case(
        [
            (F.col("status").isNull(), "NOT_FOUND"),
            (F.col("status") == "PURGED", "PURGED"),
            (F.col("busy").isNotNull() | ~F.col("status").isin(*REPROCESSABLE) | (turn != F.col("first")), "CONFLICT"),
        ],
        "QUEUED",
    )
    return joined.withColumn("outcome", outcome).drop("busy", "first", "status")


# ---------------------------------------------------------------- retention


def scope_type(document_type: Column) -> Column:
    """A blank or unknown type counts as no type."""
    trimmed = F.trim(document_type)
    return F.when((trimmed != "") & (trimmed != "UNKNOWN"), trimmed)


def resolve_retention(docs: DataFrame, policies: DataFrame, document_type: str = "document_type") -> DataFrame:
    """The policy of a document: type and product, else product, else type, else the global one.

    Each level is an exact match with null as a value, so the four lookups are plain equality joins
    on a key that spells the scope out.
    """
    def scope(kind: Column, product: Column) -> Column:
        return F.concat_ws("\u0001", F.coalesce(kind, F.lit("\u0002")), F.coalesce(product.cast("string"), F.lit("\u0002")))

    keyed = policies.select(
        scope(F.col("document_type"), F.col("product_id")).alias("_scope"),
        F.struct("policy_id", "days").alias("_policy"),
    )
    nothing = F.lit(None).cast("string")
    kind, product = scope_type(F.col(document_type)), F.col("product_id")
    levels = [scope(kind, product), scope(nothing, product), scope(kind, nothing), scope(nothing, nothing)]
    found = docs
    for level, key in enumerate(levels):
        side = hint_small(keyed.select(F.col("_scope").alias(f"_s{level}"), F.col("_policy").alias(f"_p{level}")))
        found = found.withColumn(f"_k{level}", key).join(side, F.col(f"_k{level}") == F.col(f"_s{level}"), "left")
    best = F.coalesce(*[F.col(f"_p{level}") for level in range(4)])
    return (
        found.withColumn("policy_id", best["policy_id"])
        .withColumn("retention_days", best["days"])
        .drop(*[f"_{x}{level}" for level in range(4) for x in "ksp"])
    )


def expiry(basis: Column, days: Column) -> Column:
    return basis + F.make_dt_interval(days)


def apply_retention(docs: DataFrame, policies: DataFrame, basis: str = "uploaded_at") -> DataFrame:
    resolved = resolve_retention(docs, policies)
    return resolved.withColumn("expires_at", expiry(F.col(basis), F.col("retention_days")))


def old_basis(expires: Column, days: Column, uploaded: Column) -> Column:
    """Where the running period started: expiry minus its days, else the upload."""
    return F.coalesce(expires - F.make_dt_interval(days), uploaded)


def switch_policy_on_type(docs: DataFrame, policies: DataFrame) -> DataFrame:
    """Once the type is known, a different policy takes over from the old basis."""
    named = docs.withColumnsRenamed({"policy_id": "_old_policy", "retention_days": "_old_days", "expires_at": "_old_expires"})
    resolved = resolve_retention(named, policies, "detected_type")
    switched = F.col("policy_id").isNotNull() & ~F.col("policy_id").eqNullSafe(F.col("_old_policy"))
    basis = old_basis(F.col("_old_expires"), F.col("_old_days"), F.col("uploaded_at"))
    return (
        resolved.withColumn("switched", switched)
        .withColumn("expires_at", F.when(switched, expiry(basis, F.col("retention_days"))).otherwise(F.col("_old_expires")))
        .withColumn("policy_id", F.when(switched, F.col("policy_id")).otherwise(F.col("_old_policy")))
        .withColumn("retention_days", F.when(switched, F.col("retention_days")).otherwise(F.col("_old_days")))
        .drop("_old_policy", "_old_days", "_old_expires")
    )


def reapply_policy(docs: DataFrame, policies: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(documents, new events): documents whose stored days differ from their policy's are re-based."""
    current = hint_small(policies.select("policy_id", F.col("days").alias("_days")))
    joined = docs.join(current, "policy_id", "left").withColumn(
        "reapplied", F.coalesce(~F.col("retention_days").eqNullSafe(F.col("_days")) & F.col("_days").isNotNull(), F.lit(False))
    )
    basis = old_basis(F.col("expires_at"), F.col("retention_days"), F.col("uploaded_at"))
    changed = joined.withColumn("expires_at", F.when(F.col("reapplied"), expiry(basis, F.col("_days"))).otherwise(F.col("expires_at")))
    changed = changed.withColumn("retention_days", F.when(F.col("reapplied"), F.col("_days")).otherwise(F.col("retention_days")))
    events = changed.filter("reapplied").select(
        "doc_id",
        F.lit("RETENTION_POLICY_REAPPLIED").alias("event_type"),
        F.col("status").alias("stage"),
        F.concat(F.lit("policyId="), F.col("policy_id").cast("string"), F.lit(" retentionDays="), F.col("retention_days").cast("string")).alias("details"),
        F.lit(now).cast("timestamp_ntz").alias("occurred_at"),
    )
    return changed.drop("_days"), events


def backfill_retention(docs: DataFrame, policies: DataFrame) -> DataFrame:
    """Documents without an expiry get the global policy, counted from their upload."""
    world = policies.filter(F.col("document_type").isNull() & F.col("product_id").isNull())
    one = world.agg(F.min(F.struct("policy_id", "days")).alias("p")).scalar()
    missing = F.col("expires_at").isNull()
    filled = docs.withColumn("_p", one)
    return (
        filled.withColumn("policy_id", F.when(missing, F.col("_p.policy_id")).otherwise(F.col("policy_id")))
        .withColumn("retention_days", F.when(missing, F.col("_p.days")).otherwise(F.col("retention_days")))
        .withColumn("expires_at", F.when(missing, expiry(F.col("uploaded_at"), F.col("_p.days"))).otherwise(F.col("expires_at")))
        .drop("_p")
    )


# ---------------------------------------------------------------- purge and erasure


def purgeable(docs: DataFrame, now: datetime) -> DataFrame:
    return docs.filter((F.col("expires_at") <= F.lit(now).cast("timestamp_ntz")) & F.col("status").isin(*PURGEABLE))


def purge_contents(targets: DataFrame, extractions: DataFrame, fields: DataFrame) -> DataFrame:
    """What a purge removes per document: always the file, the text if any, the fields if any.

    Fields are reduced to their extraction ids before the join, so a document with very many
    fields costs no more than one with a few.
    """
    with_fields = fields.select("extraction_id").distinct().withColumn("_filled", F.lit(True))
    kept = extractions.select("doc_id", "extraction_id", F.col("structured").isNotNull().alias("_structured"))
    flags = (
        kept.join(targets.select("doc_id"), "doc_id", "left_semi")
        .join(with_fields, "extraction_id", "left")
        .groupBy("doc_id")
        .agg(F.bool_or(F.col("_structured") | F.col("_filled").isNotNull()).alias("_content"))
    )
    joined = targets.select("doc_id").join(flags, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.array_compact(
            F.array(
                F.lit("file"),
                F.when(F.col("_content").isNotNull(), F.lit("ocr_text")),
                F.when(F.col("_content"), F.lit("extracted_fields")),
            )
        ).alias("deleted"),
    )


def _tombstones(docs: DataFrame, contents: DataFrame, event_type: str, reason: Column, now: datetime) -> tuple[DataFrame, DataFrame]:
    moment = F.lit(now).cast("timestamp_ntz")
    gone = contents.select("doc_id", F.lit(True).alias("_gone"))
    marked = docs.join(gone, "doc_id", "left")
    updated = (
        marked.withColumn("status", F.when(F.col("_gone"), "PURGED").otherwise(F.col("status")))
        .withColumn("purged_at", F.when(F.col("_gone"), moment).otherwise(F.col("purged_at")))
        .drop("_gone")
    )
    events = contents.select(
        "doc_id",
        F.lit(event_type).alias("event_type"),
        F.lit("PURGED").alias("stage"),
        F.concat(reason, F.lit(" deleted="), F.array_join("deleted", ",")).alias("details"),
        moment.alias("occurred_at"),
    )
    return updated, events


def drop_orphans(children: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Children of purged parents removed."""
    return children.join(docs.filter(F.col("status") == "PURGED").select(key), key, "left_anti")


def purge(docs: DataFrame, extractions: DataFrame, fields: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Expired documents become tombstones; their text and fields go; the log says what was removed.

    Running it again changes nothing: purged rows are not purgeable.
    """
    targets = purgeable(docs, now).select("doc_id")
    contents = purge_contents(targets, extractions, fields)
    updated, events = _tombstones(docs, contents, "PURGED", F.lit("reason=RETENTION_EXPIRED"), now)
    removed = extractions.join(targets, "doc_id", "left_semi").select("extraction_id")
    return {
        "documents": updated,
        "extractions": extractions.join(targets, "doc_id", "left_anti"),
        "fields": fields.join(removed, "extraction_id", "left_anti"),
        "events": events,
    }


def gate_erasure(requests: DataFrame, docs: DataFrame, products: DataFrame, now: datetime) -> DataFrame:
    """DOCUMENT_NOT_FOUND, product in use, retention not over, or PENDING."""
    moment = F.lit(now).cast("timestamp_ntz")
    active = hint_small(products.select("product_id", F.col("active").alias("_active")))
    joined = requests.join(docs.select("doc_id", "product_id", "expires_at").withColumn("_known", F.lit(True)), "doc_id", "left")
    return (
        joined.join(active, "product_id", "left")
        .withColumn(
            "outcome",
            first_case(
                [
                    (F.col("_known").isNull(), "DOCUMENT_NOT_FOUND"),
                    (F.col("_active"), "DOCUMENT_IN_USE_BY_PRODUCT_SERVICE"),
                    (F.col("expires_at") > moment, "RETENTION_NOT_EXPIRED"),
                ],
                "PENDING",
            ),
        )
        .drop("_known", "_active", "product_id", "expires_at")
    )


# Fixed value: the identity that approves after the waiting time.
AUTO_APPROVER = "system:auto-approve-24h"


def decide(requests: DataFrame, decisions: DataFrame, now: datetime) -> DataFrame:
    """Manual decisions; only PENDING requests can be decided."""
    verdict = decisions.select("request_id", F.col("decision").alias("_decision"), F.col("decided_by").alias("_by"))
    joined = requests.join(verdict, "request_id", "left")
    applies = (F.col("status") == "PENDING") & F.col("_decision").isin("APPROVED", "REJECTED")
    applies = F.coalesce(applies, F.lit(False))
    return (
        joined.withColumn("decided_at", F.when(applies, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("decided_at")))
        .withColumn("approved_by", F.when(applies, F.col("_by")).otherwise(F.col("approved_by")))
        .withColumn("status", F.when(applies, F.col("_decision")).otherwise(F.col("status")))
        .drop("_decision", "_by")
    )


def auto_approve(requests: DataFrame, now: datetime, after_hours: int = 24) -> DataFrame:
    """PENDING for the whole window: approved by the system identity."""
    moment = F.lit(now).cast("timestamp_ntz")
    due = (F.col("status") == "PENDING") & (F.col("requested_at") <= moment - F.make_dt_interval(hours=F.lit(after_hours)))
    return (
        requests.withColumn("_due", due)
        .withColumn("status", F.when(F.col("_due"), "APPROVED").otherwise(F.col("status")))
        .withColumn("approved_by", F.when(F.col("_due"), AUTO_APPROVER).otherwise(F.col("approved_by")))
        .withColumn("decided_at", F.when(F.col("_due"), moment).otherwise(F.col("decided_at")))
        .drop("_due")
    )


def auto_approval_audit(before: DataFrame, after: DataFrame, after_hours: int = 24) -> DataFrame:
    """Audit rows of the requests that ``auto_approve`` has just approved."""
    pending = before.filter(F.col("status") == "PENDING").select("request_id")
    approved = after.filter((F.col("status") == "APPROVED") & (F.col("approved_by") == AUTO_APPROVER)).join(pending, "request_id", "left_semi")
    waited = f"{after_hours // 24}.{after_hours % 24:02d}:00:00" if after_hours >= 24 else f"{after_hours:02d}:00:00"
    return approved.select(
        F.lit(AUTO_APPROVER).alias("user_id"),
        F.lit("GDPR_DELETION_APPROVED").alias("action"),
        F.lit("gdpr-deletion-request").alias("resource_type"),
        F.col("request_id").cast("string").alias("resource_id"),
        F.concat(F.lit("documentId="), F.col("doc_id").cast("string"), F.lit(f" autoApproveAfter={waited}")).alias("changes"),
        F.col("decided_at").alias("occurred_at"),
    )


def approved_erasures(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Approved requests with where the document's bytes are, oldest first."""
    wanted = requests.filter(F.col("status") == "APPROVED").select("request_id", "doc_id", "requested_at", "approved_by")
    placed = docs.select("doc_id", "repository_id", "storage_key")
    return wanted.join(placed, "doc_id").orderBy("requested_at", "request_id")


def execute_erasures(
    requests: DataFrame, docs: DataFrame, extractions: DataFrame, fields: DataFrame, now: datetime
) -> dict[str, DataFrame]:
    """Approved requests are carried out: tombstone (unless already one), EXECUTED, events and audit rows."""
    moment = F.lit(now).cast("timestamp_ntz")
    approved = requests.filter(F.col("status") == "APPROVED").join(docs.select("doc_id"), "doc_id", "left_semi")
    first = approved.groupBy("doc_id").agg(F.min(F.struct("requested_at", "request_id")).alias("_first"))
    targets = first.join(docs.filter(F.col("status") != "PURGED").select("doc_id"), "doc_id", "left_semi")
    contents = purge_contents(targets, extractions, fields).join(targets, "doc_id")
    reason = F.concat(F.lit("reason=GDPR_REQUEST requestId="), F.col("_first.request_id").cast("string"))
    updated, events = _tombstones(docs, contents, "GDPR_DELETION_EXECUTED", reason, now)
    executed = approved.select("request_id").withColumn("_done", F.lit(True))
    closed = (
        requests.join(executed, "request_id", "left")
        .withColumn("status", F.when(F.col("_done"), "EXECUTED").otherwise(F.col("status")))
        .withColumn("executed_at", F.when(F.col("_done"), moment).otherwise(F.col("executed_at")))
        .drop("_done")
    )
    audit = approved.select(
        F.lit(None).cast("string").alias("user_id"),
        F.lit("GDPR_DELETION_EXECUTED").alias("action"),
        F.lit("document").alias("resource_type"),
        F.col("doc_id").cast("string").alias("resource_id"),
        F.concat(
            F.lit("gdprDeletionRequestId="), F.col("request_id").cast("string"),
            F.lit(" approvedBy="), F.coalesce("approved_by", F.lit("unknown")),
        ).alias("changes"),
        moment.alias("occurred_at"),
    )
    removed = extractions.join(targets, "doc_id", "left_semi").select("extraction_id")
    return {
        "documents": updated,
        "requests": closed,
        "extractions": extractions.join(targets, "doc_id", "left_anti"),
        "fields": fields.join(removed, "extraction_id", "left_anti"),
        "events": events,
        "audit": audit,
    }


# ---------------------------------------------------------------- relocation


def migration_eligible(
    docs: DataFrame,
    events: DataFrame,
    job_id: str,
    source: str,
    document_type: str | None = None,
    product_id=None,
    uploaded_from: datetime | None = None,
    uploaded_to: datetime | None = None,
) -> DataFrame:
    """Documents the job still has to move: in the source, not purged, not moved by this job."""
    moves = parse_details(events.filter((F.col("event_type") == MIGRATED) & F.col("details").contains(job_id)))
    moved = moves.filter(F.try_element_at("detail", F.lit("migrationJobId")) == job_id).select("doc_id")
    wanted = docs.filter(
        all_of(
            [
                F.col("repository_id") == source,
                F.col("status") != "PURGED",
                equals_if(F.col("detected_type"), document_type),
                equals_if(F.col("product_id"), product_id),
                None if uploaded_from is None else F.col("uploaded_at") >= F.lit(uploaded_from).cast("timestamp_ntz"),
                None if uploaded_to is None else F.col("uploaded_at") <= F.lit(uploaded_to).cast("timestamp_ntz"),
            ]
        )
    )
    return wanted.join(moved, "doc_id", "left_anti")


def migrate_locations(docs: DataFrame, eligible: DataFrame, job_id: str, target: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(documents, new events): the eligible set points at the target repository."""
    moving = eligible.filter(F.col("repository_id") != target).select("doc_id").withColumn("_moves", F.lit(True))
    joined = docs.join(moving, "doc_id", "left")
    events = joined.filter("_moves").select(
        "doc_id",
        F.lit(MIGRATED).alias("event_type"),
        F.col("status").alias("stage"),
        F.concat(
            F.lit("fromRepositoryId="), F.col("repository_id"), F.lit(f" toRepositoryId={target} migrationJobId={job_id}")
        ).alias("details"),
        F.lit(now).cast("timestamp_ntz").alias("occurred_at"),
    )
    moved = joined.withColumn("repository_id", F.when(F.col("_moves"), target).otherwise(F.col("repository_id"))).drop("_moves")
    return moved, events
