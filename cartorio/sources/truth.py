"""Ground truth: annotations, their pairing with documents, critical fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartorio.bounds import literal_table
from cartorio.functions.expressions import first_case

STATUSES = ("VALID", "INVALID", "NOT_FOUND", "UNCERTAIN")


def load_truth(annotations: DataFrame, key: str = "doc_id", text: str = "truth_json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, expected fields, rejects) of annotation JSON texts.

    A field is null (absent), a text (its value) or an object with value or normalized, status,
    raw and messages. A document with any contract error is rejected as a whole.
    """
    bare = F.regexp_replace(text, "^﻿", "")
    read = annotations.select(key, F.try_parse_json(bare).alias("v"))
    kind = lambda v: F.schema_of_variant(v)
    get = lambda v, path, type_="string": F.try_variant_get(v, path, type_)
    fields_kind = kind(F.try_variant_get("v", "$.fields", "variant"))
    wrong = first_case(
        [
            (F.col("v").isNull(), "invalid JSON"),
            (~kind("v").startswith("OBJECT"), "not an object"),
            (
                ~F.coalesce(kind(F.try_variant_get("v", "$.documentType", "variant")) == "STRING", F.lit(False))
                | (get("v", "$.documentType") == ""),
                "documentType is required",
            ),
            (F.coalesce(~fields_kind.startswith("OBJECT"), F.lit(False)), "fields must be an object"),
        ]
    )
    headed = read.withColumn("reason", wrong.cast("string"))
    well = headed.filter(F.col("reason").isNull())
    quality = get("v", "$.quality")
    docs = well.select(
        key,
        get("v", "$.documentType").alias("document_type"),
        F.when(quality != "", quality).otherwise("unspecified").alias("quality"),
        F.coalesce(get("v", "$.legible", "boolean"), F.lit(True)).alias("legible"),
    )
    docs = docs.withColumn("quality", F.coalesce("quality", F.lit("unspecified")))

    listed = well.withColumn("f", F.try_variant_get("v", "$.fields", "variant")).filter(F.col("f").isNotNull())
    cells = listed.lateralJoin(_variant_entries(listed)).select(key, F.col("field_key").alias("path"), F.col("field_value").alias("s"))
    shape = kind("s")
    is_object, is_text, is_null = shape.startswith("OBJECT"), shape == "STRING", (shape == "VOID") | F.col("s").isNull()
    own = F.try_variant_get("s", "$.value", "variant")
    value = F.when(is_text, get("s", "$")).otherwise(F.when(own.isNotNull(), get("s", "$.value")).otherwise(get("s", "$.normalized")))
    given = get("s", "$.status")
    given = F.when(given != "", given)
    status = (
        F.when(is_null, "NOT_FOUND").when(is_text, "VALID")
        .otherwise(F.coalesce(given, F.when(value.isNotNull(), "VALID").otherwise("NOT_FOUND")))
    )
    messages = F.try_variant_get("s", "$.messages", "array<string>")
    staged = cells.select(
        key,
        "path",
        F.when(~is_null, value).alias("exp_value"),
        status.alias("exp_status"),
        F.when(is_object, get("s", "$.raw")).alias("exp_raw"),
        F.coalesce(F.when(is_object, messages), F.array().cast("array<string>")).alias("exp_messages"),
        (is_object | is_text | is_null).alias("_shaped"),
        F.coalesce(is_object & F.try_variant_get("s", "$.messages", "variant").isNotNull() & (kind(F.try_variant_get("s", "$.messages", "variant")) != "ARRAY<STRING>") & (kind(F.try_variant_get("s", "$.messages", "variant")) != "ARRAY<VOID>") & (kind(F.try_variant_get("s", "$.messages", "variant")) != "VOID"), F.lit(False)).alias("_bad_messages"),
    )
    problem = first_case(
        [
            (~F.col("_shaped"), "null, text or object expected"),
            (~F.col("exp_status").isin(*STATUSES), "unknown status"),
            (F.col("exp_status").isin("VALID", "UNCERTAIN") & F.col("exp_value").isNull(), "status needs a value"),
            ((F.col("exp_status") == "NOT_FOUND") & F.col("exp_value").isNotNull(), "NOT_FOUND has no value"),
            ((F.col("exp_status") == "INVALID") & F.col("exp_value").isNotNull(), "INVALID takes raw, not value"),
            (F.col("_bad_messages"), "messages must be a list of codes"),
        ]
    )
    judged = staged.withColumn("problem", problem.cast("string")).drop("_shaped", "_bad_messages")
    bad = judged.filter(F.col("problem").isNotNull()).groupBy(key).agg(F.min(F.struct("path", "problem")).alias("p"))
    rejects = headed.filter(F.col("reason").isNotNull()).select(key, "reason").unionByName(
        bad.select(key, F.concat(F.lit("field "), F.col("p.path"), F.lit(": "), F.col("p.problem")).alias("reason"))
    )
    fields = judged.drop("problem").join(bad.select(key), key, "left_anti")
    return docs.join(bad.select(key), key, "left_anti"), fields, rejects


def _variant_entries(listed: DataFrame) -> DataFrame:
    """Table function over the entries of the variant column ``f`` of the outer row."""
    entries = listed.sparkSession.tvf.variant_explode(F.col("f").outer())
    return entries.select(F.col("key").alias("field_key"), F.col("value").alias("field_value"))


def pair_truth(documents: DataFrame, annotations: DataFrame, stem: str = "stem") -> DataFrame:
    """PAIRED, UNANNOTATED or ORPHAN per stem."""
    left = documents.select(stem, F.col("path").alias("document_path"))
    right = annotations.select(stem, F.col("path").alias("truth_path"))
    return left.join(right, stem, "full_outer").withColumn(
        "outcome", F.when(F.col("truth_path").isNull(), "UNANNOTATED").when(F.col("document_path").isNull(), "ORPHAN").otherwise("PAIRED")
    )


def critical_fields(schemas: DataFrame, overrides: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(document_type, path) of the fields that must be right: ``required`` of the schema, or the override.

    Input columns: document_type, schema_json.
    """
    required = F.from_json("schema_json", "struct<required:array<string>>")["required"]
    listed = schemas.select("document_type", F.explode(required).alias("path"))
    if not overrides:
        return listed
    rows = [(t, p) for t, paths in overrides.items() for p in paths]
    given = literal_table(schemas.sparkSession, rows, "document_type string, path string")
    return listed.filter(~F.col("document_type").isin(*overrides)).unionByName(given)
