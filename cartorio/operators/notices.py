"""Subscription fan-out and the planning of retries and deliveries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.bounds import hint_small
from cartorio.functions.expressions import first_case

# Which statuses are announced, and under which name.
ANNOUNCED = {"COMPLETED": "document.completed", "FAILED": "document.failed", "PURGED": "document.purged"}
DELIVERY_DELAYS = (10, 30, 90)
MAX_ATTEMPTS = 3
BASE_DELAY_SECONDS = 15
MAX_DELAY_SECONDS = 300
STUCK_AFTER_SECONDS = 300


def event_name(status: Column) -> Column:
    return first_case([(status == s, name) for s, name in ANNOUNCED.items()])


def payload(event: Column) -> Column:
    """The announcement: what happened to which document, nothing that was read from it."""
    return F.to_json(
        F.struct(
            event.alias("event"),
            F.col("doc_id").alias("documentId"),
            F.col("protocol"),
            F.col("status"),
            F.col("detected_type").alias("detectedDocumentType"),
            F.col("product_code").alias("productServiceCode"),
            F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("occurredAt"),
        ),
        {"ignoreNullFields": "false"},
    )


def fan_out(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One delivery per status change and subscription that wants it.

    The product condition (any product, or this one) becomes two equality joins: subscriptions
    without a product are matched by event alone, the others by event and product.
    """
    wanted = subscriptions.filter("active").select(
        "subscription_id", F.explode("events").alias("event"), F.col("product_id").alias("_product")
    )
    told = changes.withColumn("event", event_name(F.col("status"))).filter(F.col("event").isNotNull())
    told = told.withColumn("payload", payload(F.col("event")))
    every = told.join(hint_small(wanted.filter(F.col("_product").isNull()).drop("_product").distinct()), "event")
    own = wanted.filter(F.col("_product").isNotNull()).withColumnRenamed("_product", "product_id").distinct()
    scoped = told.join(hint_small(own), ["event", "product_id"])
    return every.unionByName(scoped.select(*every.columns)).withColumns(
        {"delivery_status": F.lit("PENDING"), "next_attempt_at": F.col("occurred_at")}
    )


def seconds_later(time: Column, seconds: Column) -> Column:
    return time + F.make_dt_interval(secs=seconds)


def backoff_seconds(attempt: Column, base: int = BASE_DELAY_SECONDS, ceiling: int = MAX_DELAY_SECONDS) -> Column:
    doublings = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(32))
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), doublings), F.lit(float(ceiling))).cast("int")


def retry_plan(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Transient failures with attempts left wait and go back to PENDING; the others are FAILED.

    Columns read: transient, attempt, failed_at. Stateless, so the same code serves a stream.
    """
    retry = F.col("transient") & (F.col("attempt") < max_attempts)
    return failures.withColumns(
        {
            "job_status": F.when(retry, "PENDING").otherwise("FAILED"),
            "available_at": F.when(retry, seconds_later(F.col("failed_at"), backoff_seconds(F.col("attempt")))),
            "event_type": F.when(retry, "RETRY_SCHEDULED").otherwise("FAILED"),
        }
    )


def delivery_plan(attempts: DataFrame, delays=DELIVERY_DELAYS) -> DataFrame:
    """What follows an attempt: SUCCEEDED, a later attempt, FAILED, or CANCELLED for an inactive subscription.

    Columns read: subscription_active, success, attempt, attempted_at.
    """
    steps = F.array(*[F.lit(d) for d in delays])
    delay = F.get(steps, F.col("attempt") - 1)
    retry = ~F.col("success") & delay.isNotNull()
    status = first_case(
        [(~F.col("subscription_active"), "CANCELLED"), (F.col("success"), "SUCCEEDED"), (delay.isNotNull(), "PENDING")], "FAILED"
    )
    active = F.col("subscription_active")
    planned = attempts.withColumn("delivery_status", status)
    return planned.withColumns(
        {
            "next_attempt_at": F.when(active & retry, seconds_later(F.col("attempted_at"), delay)),
            "completed_at": F.when(F.col("delivery_status") != "PENDING", F.col("attempted_at")),
            "event_type": F.when(F.col("delivery_status") == "FAILED", "WEBHOOK_DELIVERY_FAILED"),
        }
    )


def stuck_work(heartbeats: DataFrame, now: datetime, after_seconds: int = STUCK_AFTER_SECONDS) -> DataFrame:
    """RUNNING jobs whose last sign of life is too old, as requeue events."""
    moment = F.lit(now).cast("timestamp_ntz")
    seen = heartbeats.groupBy("job_id", "doc_id").agg(
        F.max(F.struct("seen_at", "status")).alias("last"),
    )
    late = seen.filter((F.col("last.status") == "RUNNING") & (F.col("last.seen_at") < moment - F.make_dt_interval(secs=F.lit(after_seconds))))
    return late.select(
        "job_id",
        "doc_id",
        F.col("last.seen_at").alias("last_seen_at"),
        F.lit("RETRY_SCHEDULED").alias("event_type"),
        F.lit("QUEUED").alias("stage"),
        F.lit("STUCK_JOB_RECOVERED").alias("details"),
    )
