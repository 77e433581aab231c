"""Identifier, date, money and field queries over key columns printed in Brazilian form."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cartorio.functions.label_keys import with_label_keys
from cartorio.gallery.base import query
from cartorio.gallery.texts import _dotted_cnpj, _dotted_cpf, add_numbers, cnh_valid_sql, cnpj_valid_sql, cpf_valid_sql, fold_sql, numbers_sql, voter_valid_sql
from cartorio.operators import fields as fld
from cartorio.operators import intake, quality
from cartorio.operators.layout import text_layer_gate

TODAY = date(2024, 6, 30)


def _identifier_columns(s: str) -> list[str]:
    return [
        "c_custkey",
        f"CASE c_custkey % 4 WHEN 0 THEN cpf WHEN 1 THEN {_dotted_cpf('cpf')} WHEN 2 THEN concat(substr(cpf, 1, 10), CAST((CAST(substr(cpf, 11, 1) AS INT) + 1) % 10 AS {s})) ELSE ' ' END AS cpf",
        f"CASE c_custkey % 3 WHEN 0 THEN {_dotted_cnpj('cnpj')} WHEN 1 THEN cnpj ELSE concat('ab', substr(cnpj, 3)) END AS cnpj",
        "CASE WHEN c_custkey % 5 = 0 THEN '11111111111' ELSE cpf END AS cnh",
        f"concat(substr(cpf, 1, 8), lpad(CAST(c_custkey % 31 AS {s}), 2, '0'), substr(cpf, 10, 2)) AS voter",
        "CASE WHEN c_custkey % 9 = 0 THEN '00000-000' ELSE concat(substr(cpf, 1, 5), '-', substr(cpf, 6, 3)) END AS cep",
        "concat('MG-', substr(cpf, 1, 2), '.', substr(cpf, 3, 3), '.', substr(cpf, 6, 3), CASE WHEN c_custkey % 2 = 0 THEN '-x' ELSE '' END) AS rg",
        "CASE c_custkey % 4 WHEN 0 THEN 'sp' WHEN 1 THEN 'São Paulo' WHEN 2 THEN 'XX' ELSE 'Rio  Grande do Sul' END AS uf",
    ]


IDENTIFIERS = numbers_sql("customer", "c_custkey", "n") + ", ids AS (SELECT " + ", ".join(_identifier_columns("VARCHAR")) + " FROM n)"
_CELLS = ", ".join(f"('{c}', '{k}', {c})" for c, k in (("cpf", "CPF"), ("cnpj", "CNPJ"), ("cnh", "CNH"), ("voter", "VOTER"), ("cep", "CEP"), ("rg", "RG"), ("uf", "UF")))


def identifiers(t):
    return add_numbers(t.customer, "c_custkey").selectExpr(*_identifier_columns("STRING"))


@query(
    "identifier_audit",
    f"WITH {IDENTIFIERS}, cells AS (SELECT c_custkey, u.* FROM ids, LATERAL (SELECT * FROM (VALUES {_CELLS}) AS v(col, kind, raw)) AS u), "
    "norm AS (SELECT *, CASE kind WHEN 'CPF' THEN regexp_replace(raw, '[./\\- \\t]', '', 'g') WHEN 'CNPJ' THEN upper(regexp_replace(raw, '[./\\- \\t]', '', 'g')) WHEN 'UF' THEN "
    "CASE upper(raw) WHEN 'SP' THEN 'SP' WHEN 'SÃO PAULO' THEN 'SP' WHEN 'RIO  GRANDE DO SUL' THEN 'RS' ELSE '' END WHEN 'RG' THEN regexp_replace(upper(regexp_replace(raw, '[^0-9A-Za-z]', '', 'g')), '^[A-Z]+', '') ELSE regexp_replace(raw, '[^0-9]', '', 'g') END AS n FROM cells), "
    f"judged AS (SELECT *, CASE kind WHEN 'CPF' THEN length(n) = 11 AND {cpf_valid_sql('n')} WHEN 'CNPJ' THEN length(n) = 14 AND {cnpj_valid_sql('n')} WHEN 'CNH' THEN {cnh_valid_sql('n')} WHEN 'VOTER' THEN {voter_valid_sql('n')} WHEN 'CEP' THEN n <> '00000000' WHEN 'RG' THEN length(n) BETWEEN 7 AND 10 ELSE n <> '' END AS ok FROM norm) "
    "SELECT c_custkey, col AS \"column\", CASE WHEN ok THEN n END AS normalized, CASE WHEN trim(raw) = '' THEN 'NOT_FOUND' WHEN ok THEN 'VALID' ELSE 'INVALID' END AS status, "
    "CASE WHEN trim(raw) = '' THEN NULL WHEN NOT ok THEN 'CHECK_DIGIT_INVALID' WHEN kind = 'CEP' THEN 'POSTAL_CODE_VALID' WHEN kind = 'RG' THEN 'FORMAT_VALID' WHEN kind = 'UF' THEN 'STATE_VALID' ELSE 'CHECK_DIGIT_VALID' END AS message FROM judged",
)
def identifier_audit(t):
    kinds = {"cpf": "CPF", "cnpj": "CNPJ", "cnh": "CNH", "voter": "VOTER", "cep": "CEP", "rg": "RG", "uf": "UF"}
    return quality.audit_identifiers(identifiers(t), kinds, "c_custkey").select("c_custkey", "column", "normalized", "status", "message")


_MONTHS = "['JANEIRO','FEVEREIRO','MARÇO','ABRIL','MAIO','JUNHO','JULHO','AGOSTO','SETEMBRO','OUTUBRO','NOVEMBRO','DEZEMBRO']"


def printed_dates(t):
    month = F.element_at(F.array(*[F.lit(m) for m in _MONTHS.strip("[]").replace("'", "").split(",")]), F.month("o_orderdate"))
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    spoiled = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("31/02/"), F.year("o_orderdate"))).when(F.col("o_orderkey") % 7 == 1, F.replace(day, F.lit("/"), F.lit("-"))).otherwise(day)
    return t.orders.select(
        "o_orderkey",
        spoiled.alias("issue"),
        F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" de "), F.lower(month), F.lit(" de "), F.year("o_orderdate").cast("string")).alias("long"),
        F.concat(F.when(F.col("o_orderkey") % 10 == 0, F.lit("13")).otherwise(F.date_format("o_orderdate", "MM")), F.lit("/"), F.year("o_orderdate").cast("string")).alias("month"),
        F.date_format(F.add_months("o_orderdate", 360), "dd.MM.yyyy").alias("ends"),
    )


@query(
    "date_audit",
    "SELECT o_orderkey, 'issue' AS \"column\", CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS normalized, CASE WHEN o_orderkey % 7 = 0 THEN 'INVALID' ELSE 'VALID' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'DATE_INVALID' ELSE 'DATE_VALID' END AS messages FROM orders "
    "UNION ALL SELECT o_orderkey, 'long', strftime(o_orderdate, '%Y-%m-%d'), 'VALID', 'DATE_VALID' FROM orders "
    "UNION ALL SELECT o_orderkey, 'month', CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END, CASE WHEN o_orderkey % 10 = 0 THEN 'INVALID' ELSE 'VALID' END, CASE WHEN o_orderkey % 10 = 0 THEN 'DATE_INVALID' ELSE 'DATE_VALID' END FROM orders "
    "UNION ALL SELECT o_orderkey, 'ends', strftime(o_orderdate + INTERVAL 360 MONTH, '%Y-%m-%d'), 'VALID', CASE WHEN o_orderdate + INTERVAL 360 MONTH < TIMESTAMP '2024-06-30' THEN 'DATE_VALID,DOCUMENT_EXPIRED' ELSE 'DATE_VALID' END FROM orders",
)
def date_audit(t):
    kinds = {"issue": "ISSUE", "long": "LONG", "month": "MONTH", "ends": "EXPIRATION"}
    audited = quality.audit_dates(printed_dates(t), kinds, "o_orderkey", TODAY)
    return audited.select("o_orderkey", "column", "normalized", "status", F.array_join("messages", ",").alias("messages"))


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(
    "money_audit",
    f"WITH c AS (SELECT o_orderkey, {_CENTS} AS cents FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN (cents // 100) || '.00' ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS normalized, "
    "CASE WHEN o_orderkey % 8 = 0 THEN 'INVALID' ELSE 'VALID' END AS status FROM c",
)
def money_audit(t):
    cents = F.expr(_CENTS)
    whole = F.format_number((cents / 100).cast("bigint"), 0)
    dotted = F.concat(F.replace(whole, F.lit(","), F.lit(".")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    kind = F.col("o_orderkey") % 8
    printed = F.when(kind == 0, F.concat(dotted, F.lit("9"))).when(kind == 1, F.concat(F.lit("r$"), (cents / 100).cast("bigint").cast("string"))).otherwise(F.concat(F.lit("R$ "), dotted))
    return quality.audit_money(t.orders.select("o_orderkey", printed.alias("printed")), "printed", "o_orderkey").select("o_orderkey", "normalized", "status")


# ---------------------------------------------------------------- intake


@query(
    "file_triage",
    "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'SUPPORTED' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'EMPTY' WHEN 4 THEN 'UNSUPPORTED' WHEN 5 THEN 'SUPPORTED' WHEN 6 THEN 'BLOCKED' ELSE 'SUPPORTED' END AS outcome, "
    "CASE page_id % 8 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' WHEN 2 THEN 'zip-container' WHEN 5 THEN 'jpeg' WHEN 6 THEN 'html-or-xml-markup' WHEN 7 THEN 'tiff' END AS signature, "
    "CASE page_id % 8 WHEN 0 THEN false WHEN 1 THEN false WHEN 5 THEN true WHEN 7 THEN false ELSE false END AS declared_consistent FROM pages",
)
def file_triage(t):
    """Page bytes behind made-up headers; every file is declared as image/jpg."""
    lead = F.expr(
        "CASE page_id % 8 WHEN 0 THEN X'89504E470D0A1A0A' WHEN 1 THEN X'00FF255044462D312E' WHEN 2 THEN X'504B0304' WHEN 4 THEN X'0102' WHEN 5 THEN X'FFD8FFE0' WHEN 7 THEN X'4D4D002A' ELSE X'' END"
    )
    body = F.when(F.col("page_id") % 8 == 3, F.lit("")).when(F.col("page_id") % 8 == 4, F.lit("plain")).otherwise(F.col("html")).cast("binary")
    files = t.pages.select("page_id", F.concat(lead, body).alias("content"), F.lit("image/jpg; q=1").alias("declared"))
    return intake.triage_files(files, "content", "declared").select("page_id", "outcome", "signature", "declared_consistent")


@query(
    "intake_validation",
    "WITH p AS (SELECT page_id, url, strlen(html) AS size, page_id % 60 AS page_count, CASE WHEN page_id % 9 = 0 THEN repeat('r', 129) END AS ref, CASE WHEN page_id % 11 = 0 THEN 'a' || chr(7) || 'b' ELSE 'k' END AS k FROM pages) "
    "SELECT page_id, CASE WHEN regexp_replace(url, '^.*/', '') = '' THEN 'upload' ELSE regexp_replace(url, '^.*/', '') END AS clean_name, "
    "CASE WHEN ref IS NOT NULL THEN 'INVALID_FIELD' WHEN k <> 'k' THEN 'INVALID_IDEMPOTENCY_KEY' WHEN size = 0 THEN 'EMPTY_FILE' WHEN size > 20000 THEN 'FILE_TOO_LARGE' WHEN page_count > 50 THEN 'PAGE_LIMIT_EXCEEDED' END AS reject_reason FROM p",
)
def intake_validation(t):
    rows = t.pages.select(
        "page_id",
        F.col("url").alias("file_name"),
        F.octet_length("html").alias("size_bytes"),
        (F.col("page_id") % 60).alias("page_count"),
        F.when(F.col("page_id") % 9 == 0, F.repeat(F.lit("r"), 129)).alias("external_reference"),
        F.lit(None).cast("string").alias("expected_type"),
        F.when(F.col("page_id") % 11 == 0, F.lit("a\u0007b")).otherwise("k").alias("idempotency_key"),
    )
    return intake.validate_intake(rows, intake.IntakeLimits(max_bytes=20000)).select("page_id", "clean_name", "reject_reason")


@query(
    "text_gate",
    "WITH s AS (SELECT doc_id, regexp_replace(text, '[\\t-\\r \\x{85}\\p{Z}]+', '', 'g') AS dense, (doc_id % 10) / 10.0 AS image_share, doc_id % 40 AS segments, doc_id % 13 = 0 AS rotated FROM documents), "
    "a AS (SELECT *, length(regexp_replace(dense, '[^\\p{L}\\p{N}]+', '', 'g')) AS alnum FROM s) "
    "SELECT doc_id, CASE WHEN rotated OR alnum < 20 OR alnum < 0.5 * length(dense) OR (image_share >= 0.5 AND alnum < 200) OR (image_share >= 0.15 AND segments < 20) THEN 'OCR' ELSE 'NATIVE' END AS decision, "
    "CASE WHEN NOT (rotated OR alnum < 20 OR alnum < 0.5 * length(dense) OR (image_share >= 0.5 AND alnum < 200)) AND image_share >= 0.15 AND segments < 20 THEN 'IMAGE_COVERAGE_WITH_SPARSE_TEXT imageCoverage=' || printf('%.4f', image_share) || ' blocks=' || segments END AS reason FROM a",
)
def text_gate(t):
    pages = t.documents.select(
        "doc_id", "text", ((F.col("doc_id") % 10) / 10).alias("image_share"), (F.col("doc_id") % 40).alias("segments"), (F.col("doc_id") % 13 == 0).alias("rotated")
    )
    return text_layer_gate(pages).select("doc_id", "decision", "reason")


@query(
    "label_keys",
    f"WITH f AS (SELECT conv_id, turn, {fold_sql('label')} AS folded FROM (SELECT conv_id, turn, CAST(turn + 1 AS VARCHAR) || CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE '' END || ' ' || text || ' / ' || role AS label FROM conversations)), "
    "c AS (SELECT conv_id, turn, p.ord, p.part FROM f, LATERAL (SELECT 0 AS ord, folded AS part UNION ALL SELECT i, trim(string_split(folded, '/')[i]) FROM range(1, len(string_split(folded, '/')) + 1) AS r(i)) AS p), "
    "k AS (SELECT conv_id, turn, ord, regexp_replace(part, '[^\\p{L}\\p{Nd}]+', '', 'g') AS k FROM c), "
    "e AS (SELECT conv_id, turn, k FROM k WHERE k <> '' UNION SELECT conv_id, turn, regexp_replace(k, '^[0-9]{1,2}', '') FROM k WHERE regexp_matches(k, '^[0-9]{1,2}...') UNION SELECT conv_id, turn, regexp_replace(k, '^[0-9]{1,2}[A-Z]', '') FROM k WHERE regexp_matches(k, '^[0-9]{1,2}[A-Z]...') "
    "UNION SELECT conv_id, turn, regexp_replace(k, '^[0-9]{1,2}[A-Z][0-9]{1,2}', '') FROM k WHERE regexp_matches(k, '^[0-9]{1,2}[A-Z][0-9]{1,2}...')) SELECT conv_id, turn, count(*) AS keys, sha256(string_agg(k, '|' ORDER BY k)) AS digest FROM e GROUP BY 1, 2",
)
def label_keys(t):
    """Comparison keys of labels: compact, without leading numbers, and each side of a slash."""
    label = F.concat((F.col("turn") + 1).cast("string"), F.when(F.col("conv_id") % 2 == 0, "a").otherwise(""), F.lit(" "), "text", F.lit(" / "), "role")
    from cartorio.functions.folding import fold

    keyed = with_label_keys(t.conversations.select("conv_id", "turn", fold(label).alias("folded")))
    return keyed.select("conv_id", "turn", F.size("label_keys").cast("bigint").alias("keys"), F.sha2(F.array_join(F.array_sort("label_keys"), "|"), 256).alias("digest"))


# ---------------------------------------------------------------- fields


def field_rows(t):
    """Line items as fields: quantity makes the confidence, discount the penalty, flags the status."""
    return t.lineitem.selectExpr(
        "l_orderkey AS doc_id",
        "CASE WHEN l_linenumber = 7 THEN concat('partners[', CAST(l_suppkey % 3 AS STRING), '].name') ELSE concat('f', CAST(l_partkey AS STRING)) END AS field_path",
        "CAST(CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity / 53 END AS DECIMAL(5,4)) AS line_confidence",
        "CAST(l_discount * 4 AS DECIMAL(5,4)) AS penalty",
        "CASE l_returnflag WHEN 'A' THEN 'VALID' WHEN 'R' THEN 'INVALID' ELSE 'NOT_FOUND' END AS status",
        "array(l_linestatus) AS messages",
        "l_linestatus = 'F' AS found",
        "l_quantity",
    )


FIELD_ROWS = (
    "fields AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber = 7 THEN 'partners[' || l_suppkey % 3 || '].name' ELSE 'f' || l_partkey END AS field_path, CAST(CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity / 53 END AS DECIMAL(5,4)) AS line_confidence, "
    "CAST(l_discount * 4 AS DECIMAL(5,4)) AS penalty, CASE l_returnflag WHEN 'A' THEN 'VALID' WHEN 'R' THEN 'INVALID' ELSE 'NOT_FOUND' END AS status, l_linestatus AS code, l_linestatus = 'F' AS found FROM lineitem)"
)


@query(
    "field_policy",
    f"WITH {FIELD_ROWS} SELECT doc_id, field_path, CAST(least(greatest(coalesce(line_confidence, 0.8) - penalty, 0.01), 1.0) AS DOUBLE) AS confidence, CASE WHEN found AND penalty >= 0.3 AND status = 'VALID' THEN 'UNCERTAIN' ELSE status END AS status, code || CASE WHEN found AND penalty >= 0.3 THEN ',NO_LABEL_NEARBY' ELSE '' END AS messages FROM fields",
)
def field_policy(t):
    judged = fld.field_policy(field_rows(t))
    return judged.select("doc_id", "field_path", F.col("confidence").cast("double").alias("confidence"), "status", F.array_join("messages", ",").alias("messages"))


@query(
    "overall_confidence",
    f"WITH {FIELD_ROWS}, s AS (SELECT doc_id, CAST(sum(CAST(line_confidence * 10000 AS BIGINT)) AS BIGINT) AS total, count(line_confidence) AS n FROM fields GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN n > 0 THEN CAST((total // n + CASE WHEN 2 * (total % n) > n OR (2 * (total % n) = n AND (total // n) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0 AS DOUBLE) END AS overall_confidence FROM s",
)
def overall_confidence(t):
    rows = field_rows(t).withColumn("confidence", F.col("line_confidence"))
    return fld.overall_confidence(rows).select("doc_id", F.col("overall_confidence").cast("double").alias("overall_confidence"))


@query(
    "coverage",
    f"WITH {FIELD_ROWS} SELECT doc_id, count(*) AS fields, count(*) FILTER (status <> 'NOT_FOUND') AS extracted, count(*) FILTER (status = 'VALID') AS valid FROM fields WHERE NOT starts_with(field_path, 'partners[') GROUP BY doc_id",
)
def coverage(t):
    return fld.coverage(field_rows(t))


PAGES = "pages_ AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page, l_linenumber % 3 = 0 AS native, CASE WHEN l_linenumber % 4 = 3 THEN 90 * (l_orderkey % 4) ELSE 0 END AS rotation, l_orderkey % 5 = 0 AND l_linenumber = 2 AS deskewed, l_orderkey % 3 = 0 AND l_linenumber = 6 AS structured FROM lineitem)"


@query(
    "page_rollup",
    f"WITH {PAGES} SELECT doc_id, bool_or(native) AS has_native_text, CAST(min_by(rotation, page) FILTER (rotation <> 0) AS INTEGER) AS rotation, bool_or(deskewed) AS deskewed, bool_or(structured) AS used_second_engine, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (native), '') AS native_pages FROM pages_ GROUP BY doc_id",
)
def page_rollup(t):
    pages = t.lineitem.selectExpr(
        "l_orderkey AS doc_id", "l_linenumber AS page", "l_linenumber % 3 = 0 AS native",
        "CAST(CASE WHEN l_linenumber % 4 = 3 THEN 90 * (l_orderkey % 4) ELSE 0 END AS INT) AS rotation",
        "l_orderkey % 5 = 0 AND l_linenumber = 2 AS deskewed", "l_orderkey % 3 = 0 AND l_linenumber = 6 AS structured",
        "CAST(NULL AS STRING) AS native_rejected_reason",
    ).distinct()
    return fld.rollup_pages(pages).select("doc_id", "has_native_text", "rotation", "deskewed", "used_second_engine", "native_pages")


@query("protect_roundtrip", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END AS c_name, c_custkey % 50 <> 7 AS readable FROM customer")
def protect_roundtrip(t):
    """Names encrypted, a few spoiled at rest, and read back: spoiled rows are rejects."""
    names = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_name")).alias("c_name"), F.col("c_name").alias("original"))
    hidden = fld.protect(names, ["c_name"], "0123456789abcdef")
    spoiled = hidden.withColumn("c_name", F.when(F.col("c_custkey") % 50 == 7, F.lit("AAAA")).otherwise(F.col("c_name")))
    good, bad = fld.unprotect(spoiled, ["c_name"], "0123456789abcdef")
    expected = F.when(F.col("c_custkey") % 6 != 0, F.col("original"))
    return good.select("c_custkey", "c_name", F.lit(True).alias("readable")).unionByName(bad.select("c_custkey", expected.alias("c_name"), F.lit(False).alias("readable")))


@query(
    "extraction_publish",
    "SELECT doc_id, lang AS document_type, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS attempt FROM documents UNION ALL SELECT doc_id + 1000000, lang, 2 FROM documents WHERE doc_id % 10 = 0",
)
def extraction_publish(t):
    """A second attempt replaces what the first one published under the same document."""
    old = t.documents.select("doc_id", F.col("lang").alias("document_type"), F.lit(1).alias("attempt"))
    again = old.filter("doc_id % 3 = 0").withColumn("attempt", F.lit(2))
    extra = old.filter("doc_id % 10 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "document_type", F.lit(2).alias("attempt"))
    return fld.replace_by_key(old, again.unionByName(extra), ["doc_id"])


@query(
    "build_extraction",
    "WITH p AS (SELECT conv_id, turn, string_agg(text, chr(10)) AS text FROM conversations GROUP BY 1, 2) SELECT conv_id AS doc_id, count(*) AS pages, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_digest FROM p GROUP BY 1",
)
def build_extraction(t):
    """Conversations as documents, turns as pages: raw text and page texts."""
    lines = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("turn").alias("line_no"), "text")
    fields = t.conversations.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("field_path"), F.col("role").alias("normalized"), F.lit(0.5).cast("decimal(5,4)").alias("confidence"))
    built = fld.build_extraction(lines, fields)
    return built.select("doc_id", F.size("page_texts").cast("bigint").alias("pages"), F.sha2("raw_text", 256).alias("text_digest"))


@query(
    "canonical_result",
    "WITH f AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), e AS (SELECT user_id AS doc_id, count(*) AS n FROM events GROUP BY 1) "
    "SELECT o_orderkey AS doc_id, coalesce(f.n, 0) AS fields, coalesce(e.n, 0) AS entries FROM orders LEFT JOIN f ON f.doc_id = o_orderkey LEFT JOIN e ON e.doc_id = o_orderkey",
)
def canonical_result(t):
    from cartorio.gallery import archive as a

    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("field_path")).distinct()
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"raw": F.col("field_path"), "normalized": none, "confidence": none, "status": F.lit("VALID"), "messages": F.array(F.lit("X"))})
    nested = fld.canonical_result(a.documents(t), rows, a.log(t))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return nested.select("doc_id", size("fields").alias("fields"), size("timeline").alias("entries"))
