"""Evaluation of extracted fields and document classes against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.bounds import hint_small
from cartorio.functions.expressions import first_case

# Types the class indicator is about, fields with a check digit, thresholds.
PRIORITIZED_TYPES = (
    "BR_CPF_CARD", "BR_CIN", "BR_CNH", "BR_PROOF_OF_ADDRESS", "BR_CNPJ_CARD", "BR_CCMEI", "BR_SOCIAL_CONTRACT",
)
CHECK_DIGIT_FIELDS = {
    "BR_CPF_CARD": ("cpf",),
    "BR_CIN": ("cpf", "mrz"),
    "BR_CNH": ("cpf", "registrationNumber"),
    "BR_PROOF_OF_ADDRESS": ("holderDocument",),
    "BR_CNPJ_CARD": ("cnpj",),
    "BR_CCMEI": ("cnpj", "holderCpf"),
    "BR_SOCIAL_CONTRACT": ("cnpj", "partners[].cpf"),
}
THRESHOLDS = {"classification": 0.85, "textYield": 0.90, "criticalExactMatch": 0.90}
# How the outcome of a field is worded in the report.
REASONS = {
    "absent": "ausente e não devolvido",
    "invented": "o documento não traz o campo e o sistema devolveu um valor",
    "defect": "defeito reconhecido",
    "defect_missed": "o defeito não foi visto: o campo não foi lido",
    "same": "valor igual",
    "other": "valor diferente do esperado",
    "rejected": "o sistema reprovou o campo (dígito ou data) e não devolveu valor",
    "not_found": "campo não encontrado",
}
COUNTS = ("tp", "fp", "fn", "tn", "dv_correct", "dv_wrong", "dv_none")


def generic_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\[[0-9]+\]", "[]")


def align(truth_fields: DataFrame, truth_docs: DataFrame, predicted_docs: DataFrame, predicted: DataFrame) -> DataFrame:
    """Expected fields with what was returned for them; a missing prediction is NOT_FOUND.

    truth_fields: doc_id, path, exp_*; truth_docs: doc_id, document_type, quality;
    predicted_docs: doc_id, run_status; predicted: doc_id, path, status, normalized, raw, messages.
    """
    got = predicted.select(
        "doc_id", "path", F.col("status").alias("got_status"), F.col("normalized").alias("got_normalized"),
        F.col("raw").alias("got_raw"), F.col("messages").alias("got_messages"),
    )
    runs = truth_docs.select("doc_id", "document_type", "quality").join(predicted_docs.select("doc_id", "run_status"), "doc_id", "left")
    joined = truth_fields.join(runs, "doc_id").join(got, ["doc_id", "path"], "left")
    return joined.withColumns(
        {
            "got_status": F.coalesce("got_status", F.lit("NOT_FOUND")),
            "got_messages": F.coalesce("got_messages", F.array().cast("array<string>")),
            "run_status": F.coalesce("run_status", F.lit("PENDING")),
        }
    )


def score_fields(aligned: DataFrame) -> DataFrame:
    """Outcome TP, FP, FN, TN or FP+FN per expected field, its reason, counts and the check-digit verdict."""
    absent = F.col("exp_status") == "NOT_FOUND"
    done = F.col("run_status") == "COMPLETED"
    got, value = F.col("got_status"), F.col("got_normalized")
    same_raw = F.col("exp_raw").isNull() | F.coalesce(F.col("got_raw") == F.col("exp_raw"), F.lit(False))
    result = lambda outcome, reason: F.struct(F.lit(outcome).alias("o"), F.lit(reason).alias("r"))
    plain = first_case(
        [
            (~done, F.struct(F.lit("FN").alias("o"), F.concat(F.lit("documento "), F.col("run_status")).alias("r"))),
            (absent & (got == "NOT_FOUND"), result("TN", REASONS["absent"])),
            (absent, result("FP", REASONS["invented"])),
            ((F.col("exp_status") == "INVALID") & (got == "INVALID") & same_raw, result("TP", REASONS["defect"])),
            ((F.col("exp_status") == "INVALID") & (got == "NOT_FOUND"), result("FN", REASONS["defect_missed"])),
            (F.col("exp_status") == "INVALID", F.struct(F.lit("FP+FN").alias("o"), F.concat(F.lit("esperado INVALID, veio "), got).alias("r"))),
            (F.coalesce(value == F.col("exp_value"), F.lit(False)), result("TP", REASONS["same"])),
            (value.isNotNull(), result("FP+FN", REASONS["other"])),
            (got == "INVALID", result("FN", REASONS["rejected"])),
        ],
        result("FN", REASONS["not_found"]),
    )
    missing = F.array_except(F.col("exp_messages"), F.col("got_messages"))
    lacking = (F.col("p.o") == "TP") & (F.size(missing) > 0) & done
    judged = aligned.filter(done | ~absent).withColumn("p", plain).withColumn("generic", generic_path(F.col("path")))
    judged = judged.withColumn(
        "p",
        F.when(lacking, F.struct(F.lit("FN").alias("o"), F.concat(F.lit("faltam os códigos "), F.array_join(missing, ", ")).alias("r"))).otherwise(F.col("p")),
    )
    checked = first_case([(F.col("document_type") == t, F.col("generic").isin(*paths)) for t, paths in CHECK_DIGIT_FIELDS.items()], F.lit(False))
    wanted = F.when(F.col("exp_status") == "INVALID", "INVALID").otherwise("VALID")
    verdict = F.when(
        checked & ~absent & done,
        first_case([(got == wanted, "RIGHT"), (got.isin("VALID", "INVALID"), "WRONG")], "NONE"),
    )
    shown = F.coalesce("got_normalized", "got_raw")
    scored = judged.withColumns(
        {"outcome": F.col("p.o"), "reason": F.col("p.r"), "verdict": verdict,
         "expected": F.coalesce("exp_value", "exp_raw"), "got": F.when(done, shown)}
    )
    flags = {
        "tp": F.col("outcome") == "TP", "fp": F.col("outcome").isin("FP", "FP+FN"), "fn": F.col("outcome").isin("FN", "FP+FN"),
        "tn": F.col("outcome") == "TN", "dv_correct": F.coalesce(F.col("verdict") == "RIGHT", F.lit(False)),
        "dv_wrong": F.coalesce(F.col("verdict") == "WRONG", F.lit(False)), "dv_none": F.coalesce(F.col("verdict") == "NONE", F.lit(False)),
    }
    return scored.withColumns({n: f.cast("int") for n, f in flags.items()}).select(
        "doc_id", "document_type", "quality", "path", "generic", "outcome", "reason", "verdict", "expected", "got", *COUNTS
    )


def _ratio(over: Column, under: Column) -> Column:
    return F.try_divide(over.cast("double"), under.cast("double"))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and check-digit accuracy of count columns; null without a denominator."""
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    both = precision + recall
    f1 = F.when(both == 0, 0.0).otherwise(2 * precision * recall / both)
    accuracy = _ratio(F.col("dv_correct"), F.col("dv_correct") + F.col("dv_wrong"))
    return counts.withColumns(
        {"precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(f1, 4), "dv_accuracy": F.round(accuracy, 4)}
    )


def metrics(scores: DataFrame, critical: DataFrame | None = None) -> DataFrame:
    """Counts and rates per type and field, per type, per type and quality, and over all, in one pass.

    ``level``: FIELD, TYPE, QUALITY, OVERALL; with ``critical`` also CRITICAL per type.
    """
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTS]
    grouped = scores.groupingSets([["document_type", "generic"], ["document_type"], ["document_type", "quality"], []], "document_type", "generic", "quality").agg(
        F.grouping_id().alias("gid"), *sums
    )
    level = first_case([(F.col("gid") == 1, "FIELD"), (F.col("gid") == 3, "TYPE"), (F.col("gid") == 2, "QUALITY")], "OVERALL")
    table = grouped.withColumn("level", level).drop("gid")
    if critical is not None:
        listed = critical.select("document_type", F.col("path").alias("generic")).distinct()
        wanted = scores.filter(F.col("outcome") != "TN").join(hint_small(listed), ["document_type", "generic"], "left_semi")
        nothing = F.lit(None).cast("string")
        table = table.unionByName(
            wanted.groupBy("document_type").agg(*sums).withColumns({"generic": nothing, "quality": nothing, "level": F.lit("CRITICAL")})
        )
    return rates(table)


def predicted_class(results: DataFrame) -> DataFrame:
    """Results with ``predicted``: the detected type of a completed document, else its status."""
    return results.withColumn("predicted", F.when(F.col("run_status") == "COMPLETED", F.col("detected_type")).otherwise(F.col("run_status")))


def confusion(results: DataFrame) -> DataFrame:
    return predicted_class(results).groupBy("document_type", "predicted").agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(results: DataFrame, prioritized=PRIORITIZED_TYPES) -> DataFrame:
    """Accuracy over all documents and over the prioritized types."""
    hit = F.col("predicted") == F.col("document_type")
    first = F.col("document_type").isin(*prioritized)
    summed = predicted_class(results).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(hit).alias("correct"),
        F.count_if(first).alias("prioritized_documents"),
        F.count_if(first & hit).alias("prioritized_correct"),
    )
    return summed.withColumns(
        {
            "accuracy": F.round(_ratio(F.col("correct"), F.col("documents")), 4),
            "prioritized_accuracy": F.round(_ratio(F.col("prioritized_correct"), F.col("prioritized_documents")), 4),
        }
    )


def class_hits(results: DataFrame) -> DataFrame:
    """Documents and class hits per type and per type and quality."""
    hit = F.col("predicted") == F.col("document_type")
    grouped = predicted_class(results).groupingSets([["document_type"], ["document_type", "quality"]], "document_type", "quality").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(hit).alias("correct")
    )
    return grouped.withColumn("accuracy", F.round(_ratio(F.col("correct"), F.col("documents")), 4))


def text_yield(results: DataFrame, minimum_chars: int = 20) -> DataFrame:
    legible = F.col("legible")
    usable = legible & (F.col("run_status") == "COMPLETED") & (F.col("text_chars") >= minimum_chars)
    summed = results.agg(F.count_if(legible).alias("legible_documents"), F.count_if(usable).alias("usable"))
    return summed.withColumn("rate", F.round(_ratio(F.col("usable"), F.col("legible_documents")), 4))


def latency(results: DataFrame) -> DataFrame:
    """Documents, median and longest time of completed documents per type."""
    done = results.filter(F.col("run_status") == "COMPLETED")
    return done.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("documents"),
        F.round(F.median("elapsed_seconds"), 1).alias("median_seconds"),
        F.round(F.max("elapsed_seconds"), 1).alias("max_seconds"),
    )


def indicators(classified: DataFrame, yielded: DataFrame, table: DataFrame) -> DataFrame:
    """The three indicators against their thresholds; no value, no verdict."""
    critical = table.filter(F.col("level") == "CRITICAL").agg(_ratio(F.sum("tp"), F.sum("tp") + F.sum("fn")).alias("v"))
    parts = [
        classified.select(F.lit("classification").alias("indicator"), F.col("prioritized_accuracy").alias("value")),
        yielded.select(F.lit("textYield").alias("indicator"), F.col("rate").alias("value")),
        critical.select(F.lit("criticalExactMatch").alias("indicator"), F.round("v", 4).alias("value")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    threshold = first_case([(F.col("indicator") == k, F.lit(v)) for k, v in THRESHOLDS.items()])
    return every.withColumn("threshold", threshold).withColumn("passed", F.col("value") >= F.col("threshold"))


def run_summary(results: DataFrame) -> DataFrame:
    """Documents per status; COMPLETED and every other status, and their total as EVALUATED."""
    grouped = results.groupingSets([["run_status"], []], "run_status").agg(F.count(F.lit(1)).alias("documents"))
    return grouped.select(F.coalesce("run_status", F.lit("EVALUATED")).alias("run_status"), "documents")


def regressions(current: DataFrame, baseline: DataFrame, max_drop: float = 0.02) -> DataFrame:
    """Fields whose F1 fell by more than the margin, and fields or types that vanished."""
    fields = lambda t: t.filter(F.col("level") == "FIELD")
    before = fields(baseline).select("document_type", "generic", F.col("f1").alias("before"))
    after = fields(current).select("document_type", "generic", F.col("f1").alias("after"))
    present = fields(current).select("document_type").distinct().withColumn("_seen", F.lit(True))
    joined = before.join(hint_small(present), "document_type", "left").join(after, ["document_type", "generic"], "left")
    gone = joined.filter(F.col("_seen").isNull()).select("document_type").distinct()
    lost = gone.select("document_type", F.lit(None).cast("string").alias("generic"), F.lit("NO_DOCUMENTS").alias("problem"),
                       F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"))
    problem = first_case([(F.col("after").isNull(), "NOT_MEASURED"), (F.col("before") - F.col("after") > max_drop, "DROPPED")])
    fallen = joined.filter(F.col("_seen") & F.col("before").isNotNull()).withColumn("problem", problem).filter(F.col("problem").isNotNull())
    return fallen.select("document_type", "generic", "problem", "before", "after").unionByName(lost)


def problem_list(results: DataFrame, scores: DataFrame, values: bool = False) -> DataFrame:
    """Documents with a wrong field, a wrong type or no completion, with the field problems in path order.

    Values are left out unless asked for: they are personal data.
    """
    detail = [F.col("path").alias("field"), "outcome", "reason", *(("expected", "got") if values else ())]
    misses = scores.filter(~F.col("outcome").isin("TP", "TN")).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct(*detail))).alias("problems")
    )
    joined = results.join(misses, "doc_id", "left")
    fine = F.col("problems").isNull() & (F.col("run_status") == "COMPLETED") & F.coalesce(F.col("detected_type") == F.col("document_type"), F.lit(False))
    return joined.filter(~fine).select("doc_id", "document_type", "quality", "run_status", "detected_type", "problems")


def report_labels(results: DataFrame, name: str = "file_name", number: str = "number") -> DataFrame:
    """Anonymous labels: the running number and six digits of the digest of the file name."""
    digits = F.col(number).cast("string")
    padded = F.when(F.length(digits) >= 3, digits).otherwise(F.lpad(digits, 3, "0"))
    return results.withColumn("label", F.concat_ws("-", F.lit("doc"), padded, F.substring(F.sha2(name, 256), 1, 6)))


# ---------------------------------------------------------------- reading quality


def bench_stats(samples: DataFrame, key: str = "sample") -> DataFrame:
    """Median and nearest-rank 95th percentile of durations, and time per megapixel.

    The rank is round-half-even of 0.95 (n - 1). Durations are first reduced to (value, count) per
    sample, so a hot sample is a list of distinct values, not of rows; a range of counts finds the
    rank. Columns read: duration_ms, megapixels.
    """
    from pyspark.sql import Window

    distinct = samples.groupBy(key, "duration_ms").agg(F.count(F.lit(1)).alias("n"), F.max("megapixels").alias("mp"))
    running = Window.partitionBy(key).orderBy("duration_ms")
    whole = Window.partitionBy(key)
    ranked = distinct.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(whole))
    rank = F.least(F.col("total") - 1, F.rint(0.95 * (F.col("total") - 1)).cast("bigint"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("duration_ms")))
    summed = ranked.groupBy(key).agg(
        F.max("total").alias("runs"), ((at(low) + at(high)) / 2).alias("median_ms"), at(rank).alias("p95_ms"), F.max("mp").alias("megapixels")
    )
    return summed.withColumn("ms_per_megapixel", F.when(F.col("megapixels") > 0, F.col("median_ms") / F.col("megapixels")).otherwise(0.0))
