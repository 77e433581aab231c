"""Evaluation queries: orders as documents, columns as truth, planted faults as predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartorio.gallery.base import query
from cartorio.operators import scoring as sc
from cartorio.sources import truth as tr

_TYPES = ", ".join(f"'{t}'" for t in sc.PRIORITIZED_TYPES)


def _docs(spark: bool) -> str:
    kind = f"element_at(array({_TYPES}, 'OTHER'), CAST(o_custkey % 8 AS INT) + 1)" if spark else f"([{_TYPES}, 'OTHER'])[o_custkey % 8 + 1]"
    return (
        f"SELECT o_orderkey AS doc_id, {kind} AS document_type, o_orderstatus AS quality, CASE o_orderkey % 12 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'TIMEOUT' ELSE 'COMPLETED' END AS run_status, "
        f"CASE WHEN o_orderkey % 9 = 0 THEN 'UNKNOWN' ELSE {kind} END AS detected_type, o_orderkey % 11 <> 0 AS legible, CAST(floor(o_totalprice) AS BIGINT) % 100 AS text_chars, (o_orderkey % 500) / CAST(10 AS DOUBLE) AS elapsed_seconds, o_custkey FROM orders"
    )


def _truth(spark: bool) -> str:
    arr = (lambda x: f"array({x})") if spark else (lambda x: f"[{x}]")
    empty = "CAST(array() AS ARRAY<STRING>)" if spark else "CAST([] AS VARCHAR[])"
    s = "STRING" if spark else "VARCHAR"
    return (
        f"SELECT o_orderkey AS doc_id, 'cpf' AS path, CASE WHEN o_orderkey % 5 > 1 THEN concat('v', CAST(o_custkey AS {s})) END AS exp_value, CASE o_orderkey % 5 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'INVALID' ELSE 'VALID' END AS exp_status, "
        f"CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 THEN concat('r', CAST(o_custkey AS {s})) END AS exp_raw, CASE WHEN o_orderkey % 7 = 0 THEN {arr(chr(39) + 'CHECK_DIGIT_VALID' + chr(39))} ELSE {empty} END AS exp_messages FROM orders "
        f"UNION ALL SELECT o_orderkey, 'name', o_orderpriority, 'VALID', NULL, {empty} FROM orders "
        f"UNION ALL SELECT o_orderkey, concat('partners[', CAST(o_orderkey % 3 AS {s}), '].cpf'), concat('p', CAST(o_custkey AS {s})), 'VALID', NULL, {empty} FROM orders"
    )


def _predicted(spark: bool, shift: int = 9) -> str:
    arr = (lambda x: f"array({x})") if spark else (lambda x: f"[{x}]")
    empty = "CAST(array() AS ARRAY<STRING>)" if spark else "CAST([] AS VARCHAR[])"
    s = "STRING" if spark else "VARCHAR"
    return (
        f"SELECT o_orderkey AS doc_id, 'cpf' AS path, CASE o_orderkey % 4 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'UNCERTAIN' ELSE 'VALID' END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN concat('v', CAST(o_custkey + CASE WHEN o_orderkey % {shift} = 0 THEN 1 ELSE 0 END AS {s})) END AS normalized, "
        f"concat('r', CAST(o_custkey + o_orderkey % 2 AS {s})) AS raw, CASE WHEN o_orderkey % 3 = 0 THEN {arr(chr(39) + 'CHECK_DIGIT_VALID' + chr(39))} ELSE {empty} END AS messages FROM orders WHERE o_orderkey % 6 <> 0 "
        f"UNION ALL SELECT o_orderkey, 'name', 'VALID', CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority ELSE 'other' END, o_orderpriority, {empty} FROM orders "
        f"UNION ALL SELECT o_orderkey, concat('partners[', CAST(o_orderkey % 3 AS {s}), '].cpf'), CASE WHEN o_orderkey % 10 = 0 THEN 'INVALID' ELSE 'VALID' END, CASE WHEN o_orderkey % 10 <> 0 THEN concat('p', CAST(o_custkey AS {s})) END, 'x', {empty} FROM orders"
    )


ALIGNED = (
    f"runs AS ({_docs(False)}), truth AS ({_truth(False)}), pred AS ({_predicted(False)}), "
    "aligned AS (SELECT t.*, r.document_type, r.quality, r.run_status, coalesce(p.status, 'NOT_FOUND') AS got_status, p.normalized AS got_normalized, p.raw AS got_raw, coalesce(p.messages, []) AS got_messages "
    "FROM truth t JOIN runs r USING (doc_id) LEFT JOIN pred p ON t.doc_id = p.doc_id AND t.path = p.path)"
)


def scored_sql(source: str, target: str) -> str:
    return (
        f"{target}_plain AS (SELECT *, regexp_replace(path, '\\[[0-9]+\\]', '[]') AS generic, CASE WHEN run_status <> 'COMPLETED' THEN 'FN' WHEN exp_status = 'NOT_FOUND' THEN CASE WHEN got_status = 'NOT_FOUND' THEN 'TN' ELSE 'FP' END "
        "WHEN exp_status = 'INVALID' THEN CASE WHEN got_status = 'INVALID' AND (exp_raw IS NULL OR exp_raw = got_raw) THEN 'TP' WHEN got_status = 'NOT_FOUND' THEN 'FN' ELSE 'FP+FN' END "
        f"WHEN got_normalized = exp_value THEN 'TP' WHEN got_normalized IS NOT NULL THEN 'FP+FN' ELSE 'FN' END AS o FROM {source} WHERE NOT (run_status <> 'COMPLETED' AND exp_status = 'NOT_FOUND')), "
        f"{target} AS (SELECT *, CASE WHEN o = 'TP' AND run_status = 'COMPLETED' AND len(list_filter(exp_messages, lambda m: NOT list_contains(got_messages, m))) > 0 THEN 'FN' ELSE o END AS outcome, "
        "CASE WHEN exp_status <> 'NOT_FOUND' AND run_status = 'COMPLETED' AND ((document_type IN ('BR_CPF_CARD', 'BR_CIN', 'BR_CNH') AND generic = 'cpf') OR (document_type = 'BR_SOCIAL_CONTRACT' AND generic = 'partners[].cpf')) "
        f"THEN CASE WHEN got_status = CASE WHEN exp_status = 'INVALID' THEN 'INVALID' ELSE 'VALID' END THEN 'RIGHT' WHEN got_status IN ('VALID', 'INVALID') THEN 'WRONG' ELSE 'NONE' END END AS verdict FROM {target}_plain)"
    )


SCORED = f"{ALIGNED}, {scored_sql('aligned', 'scored')}"
_SUMS = (
    "CAST(count(*) FILTER (outcome = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (outcome IN ('FP', 'FP+FN')) AS BIGINT) AS fp, CAST(count(*) FILTER (outcome IN ('FN', 'FP+FN')) AS BIGINT) AS fn, CAST(count(*) FILTER (outcome = 'TN') AS BIGINT) AS tn, "
    "CAST(count(*) FILTER (verdict = 'RIGHT') AS BIGINT) AS dv_correct, CAST(count(*) FILTER (verdict = 'WRONG') AS BIGINT) AS dv_wrong, CAST(count(*) FILTER (verdict = 'NONE') AS BIGINT) AS dv_none"
)


def rates_sql(source: str) -> str:
    return (
        f"SELECT *, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN dv_correct + dv_wrong > 0 THEN CAST(dv_correct AS DOUBLE) / (dv_correct + dv_wrong) END, 4) AS dv_accuracy "
        f"FROM (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM {source})"
    )


CRITICAL = [("BR_CPF_CARD", "cpf"), ("BR_CNH", "cpf"), ("BR_CNH", "name"), ("BR_SOCIAL_CONTRACT", "partners[].cpf")]
_CRITICAL_SQL = "(document_type, generic) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in CRITICAL) + ")"
METRICS = (
    f"{SCORED}, grouped AS (SELECT 'FIELD' AS level, document_type, generic, CAST(NULL AS VARCHAR) AS quality, {_SUMS} FROM scored GROUP BY document_type, generic UNION ALL SELECT 'TYPE', document_type, NULL, NULL, {_SUMS} FROM scored GROUP BY document_type "
    f"UNION ALL SELECT 'QUALITY', document_type, NULL, quality, {_SUMS} FROM scored GROUP BY document_type, quality UNION ALL SELECT 'OVERALL', NULL, NULL, NULL, {_SUMS} FROM scored "
    f"UNION ALL SELECT 'CRITICAL', document_type, NULL, NULL, {_SUMS} FROM scored WHERE outcome <> 'TN' AND {_CRITICAL_SQL} GROUP BY document_type), metrics AS ({rates_sql('grouped')})"
)


def runs(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(_docs(True))


def aligned(t, shift: int = 9):
    t.orders.createOrReplaceTempView("orders")
    documents = runs(t)
    return sc.align(t.spark.sql(_truth(True)), documents.select("doc_id", "document_type", "quality"), documents.select("doc_id", "run_status"), t.spark.sql(_predicted(True, shift)))


def scored(t, shift: int = 9):
    return sc.score_fields(aligned(t, shift))


def critical(t):
    return t.literal(CRITICAL, "document_type string, path string")


@query("aligned_fields", f"WITH {ALIGNED} SELECT doc_id, path, exp_status, got_status, got_normalized, run_status FROM aligned")
def aligned_fields(t):
    return aligned(t).select("doc_id", "path", "exp_status", "got_status", "got_normalized", "run_status")


@query("field_scores", f"WITH {SCORED} SELECT doc_id, path, outcome, verdict FROM scored")
def field_scores(t):
    return scored(t).select("doc_id", "path", "outcome", "verdict")


@query("metrics", f"WITH {METRICS} SELECT level, document_type, generic, quality, tp, fp, fn, tn, dv_correct, dv_wrong, dv_none, precision, recall, f1, dv_accuracy FROM metrics")
def metrics(t):
    return sc.metrics(scored(t), critical(t))


@query(
    "classification_metrics",
    f"WITH runs AS ({_docs(False)}), r AS (SELECT *, CASE WHEN run_status = 'COMPLETED' THEN detected_type ELSE run_status END = document_type AS hit, document_type <> 'OTHER' AS prio FROM runs) "
    "SELECT count(*) AS documents, count(*) FILTER (hit) AS correct, count(*) FILTER (prio) AS prioritized_documents, count(*) FILTER (prio AND hit) AS prioritized_correct, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 4) AS accuracy, round(count(*) FILTER (prio AND hit) / CAST(count(*) FILTER (prio) AS DOUBLE), 4) AS prioritized_accuracy FROM r",
)
def classification_metrics(t):
    return sc.classification_metrics(runs(t))


@query("confusion", f"WITH runs AS ({_docs(False)}) SELECT document_type, CASE WHEN run_status = 'COMPLETED' THEN detected_type ELSE run_status END AS predicted, count(*) AS n FROM runs GROUP BY 1, 2")
def confusion(t):
    return sc.confusion(runs(t))


@query(
    "class_hits",
    f"WITH runs AS ({_docs(False)}), r AS (SELECT *, run_status = 'COMPLETED' AND detected_type = document_type AS hit FROM runs), g AS (SELECT document_type, NULL AS quality, count(*) AS documents, count(*) FILTER (hit) AS correct FROM r GROUP BY 1 UNION ALL SELECT document_type, quality, count(*), count(*) FILTER (hit) FROM r GROUP BY 1, 2) "
    "SELECT *, round(correct / CAST(documents AS DOUBLE), 4) AS accuracy FROM g",
)
def class_hits(t):
    return sc.class_hits(runs(t))


@query(
    "text_yield",
    "WITH r AS (SELECT d.doc_id, coalesce(l.quality, 1) = 1 AS legible, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)), s AS (SELECT count(*) FILTER (legible) AS legible_documents, count(*) FILTER (legible AND doc_id % 9 <> 0 AND n_chars >= 200) AS usable FROM r) "
    "SELECT legible_documents, usable, round(usable / CAST(legible_documents AS DOUBLE), 4) AS rate FROM s",
)
def text_yield(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        (F.coalesce("quality", F.lit(1)) == 1).alias("legible"), F.when(F.col("doc_id") % 9 == 0, "FAILED").otherwise("COMPLETED").alias("run_status"), F.col("n_chars").alias("text_chars")
    )
    return sc.text_yield(rows, 200)


@query("latency", f"WITH runs AS ({_docs(False)}) SELECT document_type, count(*) AS documents, round(median(elapsed_seconds), 1) AS median_seconds, round(max(elapsed_seconds), 1) AS max_seconds FROM runs WHERE run_status = 'COMPLETED' GROUP BY 1")
def latency(t):
    return sc.latency(runs(t))


@query("run_summary", f"WITH runs AS ({_docs(False)}) SELECT run_status, count(*) AS documents FROM runs GROUP BY 1 UNION ALL SELECT 'EVALUATED', count(*) FROM runs")
def run_summary(t):
    return sc.run_summary(runs(t))


@query(
    "indicators",
    f"WITH {METRICS}, c AS (SELECT CAST(sum(tp) AS DOUBLE) / (sum(tp) + sum(fn)) AS v FROM metrics WHERE level = 'CRITICAL'), k AS (SELECT count(*) FILTER (run_status = 'COMPLETED' AND detected_type = document_type AND document_type <> 'OTHER') / CAST(count(*) FILTER (document_type <> 'OTHER') AS DOUBLE) AS v FROM runs), "
    "y AS (SELECT count(*) FILTER (legible AND run_status = 'COMPLETED' AND text_chars >= 5) / CAST(count(*) FILTER (legible) AS DOUBLE) AS v FROM runs), every AS (SELECT 'classification' AS indicator, round(v, 4) AS value, 0.85 AS t FROM k UNION ALL SELECT 'textYield', round(v, 4), 0.9 FROM y UNION ALL SELECT 'criticalExactMatch', round(v, 4), 0.9 FROM c) "
    "SELECT indicator, value, CAST(t AS DOUBLE) AS threshold, value >= t AS passed FROM every",
)
def indicators(t):
    results = runs(t)
    return sc.indicators(sc.classification_metrics(results), sc.text_yield(results, 5), sc.metrics(scored(t), critical(t)))


@query(
    "problems",
    f"WITH {SCORED}, m AS (SELECT doc_id, string_agg(path || '=' || outcome, ';' ORDER BY path) AS misses FROM scored WHERE outcome NOT IN ('TP', 'TN') GROUP BY doc_id) "
    "SELECT r.doc_id, r.run_status, coalesce(m.misses, '') AS misses FROM runs r LEFT JOIN m USING (doc_id) WHERE m.misses IS NOT NULL OR r.run_status <> 'COMPLETED' OR r.detected_type <> r.document_type",
)
def problems(t):
    listed = sc.problem_list(runs(t), scored(t))
    text = F.array_join(F.transform("problems", lambda p: F.concat(p["field"], F.lit("="), p["outcome"])), ";")
    return listed.select("doc_id", "run_status", F.coalesce(text, F.lit("")).alias("misses"))


OTHER = f"pred2 AS ({_predicted(False, 2)}), aligned2 AS (SELECT t.*, r.document_type, r.quality, r.run_status, coalesce(p.status, 'NOT_FOUND') AS got_status, p.normalized AS got_normalized, p.raw AS got_raw, coalesce(p.messages, []) AS got_messages FROM truth t JOIN runs r USING (doc_id) LEFT JOIN pred2 p ON t.doc_id = p.doc_id AND t.path = p.path WHERE r.document_type <> 'BR_CCMEI')"


@query(
    "regressions",
    f"WITH {SCORED}, {OTHER}, {scored_sql('aligned2', 'scored2')}, g1 AS (SELECT document_type, generic, {_SUMS} FROM scored GROUP BY 1, 2), g2 AS (SELECT document_type, generic, {_SUMS} FROM scored2 GROUP BY 1, 2), base AS ({rates_sql('g1')}), cur AS ({rates_sql('g2')}) "
    "SELECT b.document_type, b.generic, CASE WHEN c.f1 IS NULL THEN 'NOT_MEASURED' ELSE 'DROPPED' END AS problem, b.f1 AS before, c.f1 AS after FROM base b LEFT JOIN cur c ON b.document_type = c.document_type AND b.generic = c.generic WHERE b.document_type <> 'BR_CCMEI' AND b.f1 IS NOT NULL AND (c.f1 IS NULL OR b.f1 - c.f1 > 0.02) "
    "UNION ALL SELECT 'BR_CCMEI', NULL, 'NO_DOCUMENTS', NULL, NULL",
)
def regressions(t):
    """A worse run against a stored one; one type has no documents any more."""
    current = sc.metrics(sc.score_fields(aligned(t, 2).filter("document_type <> 'BR_CCMEI'")))
    return sc.regressions(current, sc.metrics(scored(t)))


@query("report_labels", "SELECT o_orderkey AS doc_id, 'doc-' || CASE WHEN o_orderkey < 1000 THEN lpad(CAST(o_orderkey AS VARCHAR), 3, '0') ELSE CAST(o_orderkey AS VARCHAR) END || '-' || left(sha256('order_' || o_orderkey), 6) AS label FROM orders")
def report_labels(t):
    rows = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("number"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("file_name"))
    return sc.report_labels(rows).select("doc_id", "label")


@query(
    "bench_stats",
    "WITH d AS (SELECT l_returnflag || l_linestatus AS sample, CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS ms FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY sample) AS n FROM d) "
    "SELECT sample, max(n) AS runs, median(ms) AS median_ms, CAST(max(ms) FILTER (i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS BIGINT) AS p95_ms, round(median(ms) / 2.5, 6) AS ms_per_megapixel FROM r GROUP BY sample",
)
def bench_stats(t):
    rows = t.lineitem.selectExpr("concat(l_returnflag, l_linestatus) AS sample", "CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS duration_ms", "CAST(2.5 AS DOUBLE) AS megapixels")
    return sc.bench_stats(rows).select("sample", "runs", "median_ms", "p95_ms", F.round("ms_per_megapixel", 6).alias("ms_per_megapixel"))


# ---------------------------------------------------------------- annotations

_JSON = (
    "CASE doc_id % 10 WHEN 0 THEN '{bad' WHEN 1 THEN '{\"documentType\":\"\",\"fields\":{}}' WHEN 2 THEN '{\"documentType\":\"BR_CNH\",\"fields\":{\"name\":{\"status\":\"WRONG\",\"value\":\"x\"}}}' WHEN 3 THEN '{\"documentType\":\"BR_CNH\",\"fields\":{\"name\":{\"status\":\"INVALID\",\"value\":\"x\"}}}' "
    "WHEN 4 THEN '{\"documentType\":\"BR_CNH\",\"fields\":[1]}' ELSE concat('{\"documentType\":\"BR_CNH\",\"quality\":\"q', CAST(quality AS {s}), '\",\"legible\":', CASE WHEN toxic = 1 THEN 'false' ELSE 'true' END, ',\"fields\":{\"cpf\":\"', CAST(doc_id AS {s}), '\",\"rg\":null,\"name\":{\"normalized\":\"N', CAST(doc_id AS {s}), '\",\"messages\":[\"A\",\"B\"]},\"mrz\":{\"status\":\"INVALID\",\"raw\":\"R\"}}}') END"
)


def annotations(t):
    return t.labels.select("doc_id", F.expr(_JSON.replace("{s}", "STRING")).alias("truth_json"))


@query(
    "truth_load",
    "WITH good AS (SELECT * FROM labels WHERE doc_id % 10 > 4) SELECT doc_id, 'cpf' AS path, CAST(doc_id AS VARCHAR) AS exp_value, 'VALID' AS exp_status, CAST(NULL AS VARCHAR) AS exp_raw, '' AS exp_messages FROM good UNION ALL SELECT doc_id, 'rg', NULL, 'NOT_FOUND', NULL, '' FROM good "
    "UNION ALL SELECT doc_id, 'name', 'N' || doc_id, 'VALID', NULL, 'A,B' FROM good UNION ALL SELECT doc_id, 'mrz', NULL, 'INVALID', 'R', '' FROM good",
)
def truth_load(t):
    _, fields, _ = tr.load_truth(annotations(t))
    return fields.select("doc_id", "path", "exp_value", "exp_status", "exp_raw", F.array_join("exp_messages", ",").alias("exp_messages"))


@query("truth_documents", "SELECT doc_id, 'BR_CNH' AS document_type, 'q' || quality AS quality, toxic <> 1 AS legible FROM labels WHERE doc_id % 10 > 4")
def truth_documents(t):
    return tr.load_truth(annotations(t))[0]


@query(
    "truth_rejects",
    "SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'documentType is required' WHEN 2 THEN 'field name: unknown status' WHEN 3 THEN 'field name: INVALID takes raw, not value' ELSE 'fields must be an object' END AS reason FROM labels WHERE doc_id % 10 <= 4",
)
def truth_rejects(t):
    return tr.load_truth(annotations(t))[2]


@query(
    "truth_pairing",
    "SELECT outcome, count(*) AS stems FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'UNANNOTATED' WHEN d.doc_id IS NULL THEN 'ORPHAN' ELSE 'PAIRED' END AS outcome FROM (SELECT * FROM documents WHERE doc_id % 7 <> 0) d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1",
)
def truth_pairing(t):
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    documents = t.documents.filter("doc_id % 7 <> 0").select(stem.alias("stem"), F.concat(stem, F.lit(".pdf")).alias("path"))
    truths = t.labels.select(stem.alias("stem"), F.concat(stem, F.lit(".truth.json")).alias("path"))
    return tr.pair_truth(documents, truths).groupBy("outcome").agg(F.count(F.lit(1)).alias("stems"))


@query(
    "critical_fields",
    "SELECT n_name AS document_type, u.path FROM nation, LATERAL (SELECT unnest(CASE WHEN n_name = 'NATION_3' THEN ['only'] ELSE ['cpf', 'k' || n_regionkey] END) AS path) AS u",
)
def critical_fields(t):
    schemas = t.nation.select(F.col("n_name").alias("document_type"), F.concat(F.lit('{"$id":"x","required":["cpf","k'), F.col("n_regionkey").cast("string"), F.lit('"]}')).alias("schema_json"))
    return tr.critical_fields(schemas, {"NATION_3": ["only"]})
