"""Audits of identifier, date, money and machine-readable columns."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.functions.check_digits import KINDS
from cartorio.functions.dates import iso, parse_date, parse_long_date, parse_money, parse_month, plausible
from cartorio.functions.expressions import first_case, text_array

# Codes reported next to a verdict.
CHECK_DIGIT_VALID, CHECK_DIGIT_INVALID = "CHECK_DIGIT_VALID", "CHECK_DIGIT_INVALID"
DATE_VALID, DATE_INVALID, DOCUMENT_EXPIRED = "DATE_VALID", "DATE_INVALID", "DOCUMENT_EXPIRED"
FORMAT_VALID, POSTAL_CODE_VALID, STATE_VALID = "FORMAT_VALID", "POSTAL_CODE_VALID", "STATE_VALID"
RIGHT_CODE = {"CEP": POSTAL_CODE_VALID, "UF": STATE_VALID, "RG": FORMAT_VALID}


def audit_identifiers(df: DataFrame, columns: Mapping[str, str], key: str) -> DataFrame:
    """One row per identifier column and row: normalized value, status and code.

    The normal form is projected first and judged in a second step, so its regular expressions
    run once per value although the check digits read it many times.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(c).cast("string").alias("raw"))
        for c, kind in columns.items()
    ]
    long = df.select(key, F.explode_outer(F.array(*cells)).alias("c")).select(key, "c.*")
    kinds = sorted(set(columns.values()))
    normal = first_case([(F.col("kind") == k, KINDS[k][0](F.col("raw"))) for k in kinds])
    judged = [(F.col("kind") == k, KINDS[k][1](F.col("_normal")) if KINDS[k][1] else F.lit(True)) for k in kinds]
    blank = F.coalesce(F.trim("raw") == "", F.lit(True))
    named = long.withColumn("_normal", normal).withColumn("_right", F.col("_normal").isNotNull() & first_case(judged))
    code = first_case([(F.col("kind") == k, RIGHT_CODE.get(k, CHECK_DIGIT_VALID)) for k in kinds])
    return named.select(
        key,
        "column",
        "kind",
        "raw",
        F.when(F.col("_right"), F.col("_normal")).alias("normalized"),
        first_case([(blank, "NOT_FOUND"), (F.col("_right"), "VALID")], "INVALID").alias("status"),
        first_case([(blank, F.lit(None)), (F.col("_right"), code)], CHECK_DIGIT_INVALID).alias("message"),
    )


def verdict_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def audit_dates(df: DataFrame, columns: Mapping[str, str], key: str, today: date) -> DataFrame:
    """Date columns by kind BIRTH, ISSUE, EXPIRATION, ANY, LONG or MONTH."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(c).alias("raw")) for c, kind in columns.items()
    ]
    long = df.select(key, F.explode_outer(F.array(*cells)).alias("c")).select(key, "c.*")
    kind = F.col("kind")
    day = F.when(kind == "LONG", parse_long_date(F.col("raw"))).when(kind != "MONTH", parse_date(F.col("raw")))
    month = F.when(kind == "MONTH", parse_month(F.col("raw")))
    parsed = long.withColumn("_day", day).withColumn("_month", month)
    scope = F.when(kind == "LONG", "ISSUE").otherwise(kind)
    right = F.coalesce(F.col("_month").isNotNull() | plausible(F.col("_day"), scope, today), F.lit(False))
    expired = (kind == "EXPIRATION") & (F.col("_day") < F.lit(today))
    blank = F.coalesce(F.trim("raw") == "", F.lit(True))
    return parsed.select(
        key,
        "column",
        "kind",
        "raw",
        F.when(right, F.coalesce("_month", iso(F.col("_day")))).alias("normalized"),
        first_case([(blank, "NOT_FOUND"), (right, "VALID")], "INVALID").alias("status"),
        F.when(blank, text_array([]))
        .when(right & F.coalesce(expired, F.lit(False)), text_array([DATE_VALID, DOCUMENT_EXPIRED]))
        .when(right, text_array([DATE_VALID]))
        .otherwise(text_array([DATE_INVALID]))
        .alias("messages"),
    )


def audit_money(df: DataFrame, column: str, key: str) -> DataFrame:
    amount = parse_money(F.col(column))
    blank = F.coalesce(F.trim("raw") == "", F.lit(True))
    return df.select(key, F.col(column).alias("raw"), amount.alias("normalized")).withColumn(
        "status", first_case([(blank, "NOT_FOUND"), (F.col("normalized").isNotNull(), "VALID")], "INVALID")
    )
