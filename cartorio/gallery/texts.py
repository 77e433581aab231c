"""Text, classification and privacy queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartorio.bounds import literal_table
from cartorio.functions.approximate import LETTERS_PER_EDIT, MAX_EDITS, SUBSTRING_LENGTH
from cartorio.functions.folding import compact_of, fold, fold_table, normalize_text
from cartorio.gallery.base import query, values
from cartorio.session import cut_lineage
from cartorio.operators import classify as cls
from cartorio.operators import intake, privacy
from cartorio.sources.lines import LINE_BREAK, to_lines
from cartorio.sources.rules import load_rules, profile_json

# Example rule catalogue: one word-list profile per language of the generated texts.
PROFILES = [
    ("LANG_EN", 0, "0.60", [("articles", "0.40", ["the", "an"]), ("links", "0.30", ["and", "of"]), ("forms", "0.20", ["thenthat", "retionof"]), ("rest", "0.25", ["that", "whst"])],
     [("german", "0.50", ["der", "und"]), ("french", "0.40", ["des", "dans"])]),
    ("LANG_DE", 1, "0.60", [("articles", "0.45", ["der", "die", "das"]), ("links", "0.35", ["und", "nicht"]), ("forms", "0.20", ["schenlich", "derdiedas"])],
     [("english", "0.50", ["the"])]),
    ("LANG_FR", 2, "0.50", [("articles", "0.40", ["le", "la", "les"]), ("links", "0.30", ["et", "des"]), ("forms", "0.15", ["mentdans", "éreaux"])],
     [("spanish", "0.30", ["el", "los"])]),
    ("LANG_ES", 3, "0.50", [("articles", "0.40", ["el", "los", "la"]), ("links", "0.30", ["y", "que"]), ("forms", "0.15", ["cióndel"])],
     [("french", "0.30", ["le", "et"])]),
]
REJECTED = [("BROKEN", 4, True, "{not json"), ("EMPTY", 5, True, '{"evidence":[],"threshold":0.5}'), ("HIGH", 6, True, '{"evidence":[{"name":"x","weight":0.5,"patterns":["x"]}],"threshold":1.5}'),
            ("OFF", 7, False, '{"evidence":[{"name":"x","weight":0.5,"patterns":["x"]}],"threshold":0.5}')]


def type_rows(spark):
    rows = [(n, p, True, profile_json({k: (w, pats) for k, w, pats in ev}, {k: (w, pats) for k, w, pats in co}, th)) for n, p, th, ev, co in PROFILES]
    return literal_table(spark, rows + REJECTED, "document_type string, position int, active boolean, rules_json string")


def rules(t):
    return load_rules(type_rows(t.spark))[0]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fold_sql(column: str, form: str = "NFD") -> str:
    source, target = fold_table(form)
    bare = f"regexp_replace(translate({column}, {sql_text(source)}, {sql_text(target)}), '\\p{{Mn}}+', '', 'g')"
    return f"trim(regexp_replace({bare}, '[\\t-\\r \\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


WORD_BREAK = "'[^\\p{L}\\p{Nd}]+'"
SEARCH = (
    f"folded AS (SELECT doc_id, lang, {fold_sql('text')} AS folded FROM documents), "
    f"search AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(folded, {WORD_BREAK}, ' ', 'g')) || ' ' AS words, regexp_replace(folded, {WORD_BREAK}, '', 'g') AS compact FROM folded)"
)


def plain_pattern(pattern: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", pattern) if unicodedata.category(c) != "Mn").upper()


def _pattern_sql(pattern: str) -> str:
    plain = plain_pattern(pattern)
    return f"contains(compact, '{plain}')" if len(plain) >= 8 else f"contains(words, ' {plain} ')"


def _evidence_rows():
    for name, position, threshold, evidence, counter in PROFILES:
        for side, items in (("E", evidence), ("C", counter)):
            for label, weight, patterns in items:
                yield name, position, threshold, side, label, weight, " OR ".join(_pattern_sql(p) for p in patterns)


def _scores_sql() -> str:
    cases = []
    for name, position, threshold, _, _ in PROFILES:
        terms = "".join(f" {'+' if side == 'E' else '-'} CASE WHEN {test} THEN {round(float(w) * 100)} ELSE 0 END" for n, _, _, side, _, w, test in _evidence_rows() if n == name)
        cases.append(f"SELECT doc_id, lang, '{name}' AS document_type, {position} AS pos, {round(float(threshold) * 100)} AS threshold, greatest(least(0{terms}, 100), 0) AS points FROM search")
    return "scored AS (" + " UNION ALL ".join(cases) + ")"


SCORED = f"{SEARCH}, {_scores_sql()}"
BEST = f"{SCORED}, best AS (SELECT d.doc_id, d.lang, b.document_type, b.points FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, pos) AS rn FROM scored WHERE points >= threshold) b ON d.doc_id = b.doc_id AND rn = 1)"
RECORDED = "CASE lang WHEN 'en' THEN 'LANG_EN' WHEN 'de' THEN 'LANG_DE' WHEN 'fr' THEN 'LANG_FR' ELSE 'LANG_ES' END"


@query(
    "classify_documents",
    f"WITH {BEST} SELECT coalesce(document_type, 'UNKNOWN') AS document_type, count(*) AS documents, round(avg(points) / 100.0, 4) AS mean_score FROM best GROUP BY 1",
)
def classify_documents(t):
    """Documents per type with the mean score of the winners: the flagship query."""
    classified = cls.classify(t.documents, rules(t), fuzzy=False)
    mean = F.round(F.sum((F.col("score") * 10000).cast("bigint")) / F.count("score") / 10000.0, 4)
    return classified.groupBy("document_type").agg(F.count(F.lit(1)).alias("documents"), F.when(F.count("score") > 0, mean).alias("mean_score"))


@query("classified_documents", f"WITH {BEST} SELECT doc_id, coalesce(document_type, 'UNKNOWN') AS document_type, CAST(points / 100.0 AS DOUBLE) AS score FROM best")
def classified_documents(t):
    return cls.classify(t.documents, rules(t), fuzzy=False).select("doc_id", "document_type", F.col("score").cast("double").alias("score"))


@query("classify_by_join", f"WITH {BEST} SELECT doc_id, coalesce(document_type, 'UNKNOWN') AS document_type, CAST(points / 100.0 AS DOUBLE) AS score FROM best")
def classify_by_join(t):
    """The same decision for rule tables too large to be constants."""
    return cls.classify_by_join(t.documents, rules(t)).select("doc_id", "document_type", F.col("score").cast("double").alias("score"))


# DuckDB counts edits in bytes: letters of several bytes are all written as one sign.
ONE_SIGN = "regexp_replace({}, '[^\\x00-\\x7F]', '~', 'g')"


def approximate_sql(texts: str, patterns: str) -> str:
    """CTEs up to ``near`` (doc_id, pattern, edits) for texts (doc_id, compact) and patterns (pattern) of eight letters or more.

    A piece of the pattern has to stand in the text as it is; around it, every window of a possible start and length is measured.
    """
    return (
        f"sized AS (SELECT pattern, length(pattern) AS size, CAST(least({MAX_EDITS}, length(pattern) // {LETTERS_PER_EDIT}) AS INTEGER) AS most FROM {patterns}), "
        "pieces AS (SELECT *, size * n // (most + 1) AS ahead, substr(pattern, size * n // (most + 1) + 1, size * (n + 1) // (most + 1) - size * n // (most + 1)) AS piece FROM (SELECT *, unnest(range(0, most + 1)) AS n FROM sized)), "
        f"letters AS (SELECT doc_id, compact, unnest(range(1, length(compact) + 1)) AS pos FROM {texts}), "
        "starts AS (SELECT doc_id, compact, pos, substr(compact, pos, 4) AS four FROM letters), "
        "hits AS (SELECT DISTINCT doc_id, compact, pattern, size, most, pos - ahead AS start FROM starts JOIN pieces ON four = left(piece, 4) AND substr(compact, pos, length(piece)) = piece), "
        "windows AS (SELECT doc_id, compact, pattern, most, start + a AS start, size + b AS size FROM hits, range(-3, 4) x(a), range(-3, 4) y(b) WHERE abs(a) <= most AND abs(b) <= most AND start + a >= 1), "
        "near AS (SELECT doc_id, pattern, CAST(min(levenshtein(pattern, substr(compact, start, size))) AS INTEGER) AS edits FROM windows WHERE levenshtein(pattern, substr(compact, start, size)) <= most GROUP BY 1, 2)"
    )


def _fuzzy_sql() -> str:
    rows = [(name, position, threshold, side, number, label, weight, plain_pattern(p))
            for name, position, threshold, evidence, counter in PROFILES for side, items in (("E", evidence), ("C", counter))
            for number, (label, weight, patterns) in enumerate(items) for p in patterns]
    listed = values([(n, p, round(float(t) * 100), s, i, e, round(float(w) * 100), x) for n, p, t, s, i, e, w, x in rows], "document_type, pos, threshold, side, ordinal, name, points, pattern")
    return (
        f"WITH {SEARCH}, rules AS {listed}, signs AS (SELECT doc_id, {ONE_SIGN.format('compact')} AS compact FROM search), long AS (SELECT DISTINCT pattern FROM rules WHERE length(pattern) >= {SUBSTRING_LENGTH}), "
        f"{approximate_sql('signs', 'long')}, "
        f"found AS (SELECT doc_id, pattern FROM near UNION ALL SELECT doc_id, pattern FROM search JOIN (SELECT DISTINCT pattern FROM rules WHERE length(pattern) < {SUBSTRING_LENGTH}) ON contains(words, ' ' || pattern || ' ')), "
        "evidence AS (SELECT DISTINCT doc_id, document_type, pos, threshold, side, ordinal, name, points FROM found JOIN rules USING (pattern)), "
        "scored AS (SELECT doc_id, document_type, pos, threshold, greatest(least(sum(CASE side WHEN 'E' THEN points ELSE -points END), 100), 0) AS points, "
        "coalesce(string_agg(name, ',' ORDER BY ordinal) FILTER (side = 'E'), '') AS signals FROM evidence GROUP BY ALL), "
        "best AS (SELECT * FROM scored WHERE points >= threshold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, pos) = 1) "
        "SELECT doc_id, coalesce(document_type, 'UNKNOWN') AS document_type, CAST(points / 100.0 AS DOUBLE) AS score, coalesce(signals, '') AS signals FROM documents LEFT JOIN best USING (doc_id)"
    )


@query("classify_fuzzy", _fuzzy_sql())
def classify_fuzzy(t):
    """Approximate matching included; types may only gain evidence over the exact query."""
    return cls.classify(t.documents, rules(t)).select("doc_id", "document_type", F.col("score").cast("double").alias("score"), F.array_join("signals", ",").alias("signals"))


def _planted() -> str:
    """``plain`` with 0 to 3 edits, by the item's number: a letter put in, one left out, one replaced."""
    place = lambda share: f"CAST(floor(length(plain) * {share}) AS INT)"
    replaced = f"CASE WHEN item_id % 4 >= 3 THEN concat(substr(plain, 1, {place(0.75)}), 'X', substr(plain, {place(0.75)} + 2)) ELSE plain END"
    shortened = f"CASE WHEN item_id % 4 >= 2 THEN concat(substr({replaced}, 1, {place(0.5)}), substr({replaced}, {place(0.5)} + 2)) ELSE {replaced} END"
    return f"CASE WHEN item_id % 4 >= 1 THEN concat(substr({shortened}, 1, {place(0.25)}), 'X', substr({shortened}, {place(0.25)} + 1)) ELSE {shortened} END"


_LINE_PATTERNS = (
    f"lines AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark), "
    f"plains AS (SELECT item_id, {ONE_SIGN.format(f'regexp_replace({fold_sql("line")}, {WORD_BREAK}, {chr(39) * 2}, {chr(39)}g{chr(39)})')} AS plain FROM lines), "
    f"patterns AS (SELECT DISTINCT {_planted()} AS pattern FROM plains)"
)


@query(
    "approximate_lines",
    f"WITH {SEARCH}, signs AS (SELECT doc_id, {ONE_SIGN.format('compact')} AS compact FROM search), {_LINE_PATTERNS}, long AS (SELECT pattern FROM patterns WHERE length(pattern) >= {SUBSTRING_LENGTH}), "
    f"{approximate_sql('signs', 'long')} SELECT doc_id, pattern, edits FROM near",
)
def approximate_lines(t):
    """Misspelt lines of benchmark texts that stand in a document with up to three edits, as a join with a table of patterns."""
    signs = lambda text: F.regexp_replace(compact_of(fold(F.col(text))), "[^\\x00-\\x7F]", "~")
    texts = t.documents.select("doc_id", signs("text").alias("compact"))
    lines = t.benchmark.select("item_id", F.explode(F.split("text", "\n")).alias("line")).select("item_id", signs("line").alias("plain"))
    lines = lines.select(F.expr(_planted()).alias("pattern_compact"))
    long = lines.filter(F.length("pattern_compact") >= SUBSTRING_LENGTH)
    return cls.fuzzy_join(texts, long, "doc_id").select("doc_id", F.col("pattern_compact").alias("pattern"), "edits")


@query(
    "classification_candidates",
    f"WITH {SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, pos) AS rank, points >= threshold AS accepted FROM scored), "
    "w AS (SELECT doc_id, min(rank) AS won FROM ranked WHERE accepted GROUP BY doc_id) "
    "SELECT r.doc_id, CAST(rank AS INTEGER) AS rank, document_type, CAST(points / 100.0 AS DOUBLE) AS score, accepted, coalesce(rank = won, false) AS chosen FROM ranked r LEFT JOIN w USING (doc_id)",
)
def classification_candidates(t):
    explained = cls.explain_classification(t.documents, rules(t), fuzzy=False)
    return explained.select("doc_id", "rank", "document_type", F.col("score").cast("double").alias("score"), "accepted", "chosen")


@query(
    "classification_decisions",
    f"WITH {SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, pos) AS rank FROM scored), "
    "w AS (SELECT doc_id, min_by(r, rank) FILTER (points >= threshold) AS won, min_by(r, rank) AS top FROM ranked r GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN won IS NOT NULL THEN won.document_type || ' chosen with score ' || printf('%.2f', won.points / 100.0) || ' (threshold ' || printf('%.2f', won.threshold / 100.0) || '), best of 4 types tried.' "
    "WHEN compact = '' THEN 'The text is empty, so there was nothing to classify.' WHEN top.points <= 0 THEN 'No evidence of any known type was found in the text.' "
    "ELSE 'No type reached its threshold. Closest: ' || top.document_type || ' with score ' || printf('%.2f', top.points / 100.0) || ' of ' || printf('%.2f', top.threshold / 100.0) || '.' END AS reason FROM w JOIN search USING (doc_id)",
)
def classification_decisions(t):
    return cls.decisions(cls.explain_classification(t.documents, rules(t), fuzzy=False)).select("doc_id", "reason")


@query(
    "rule_evidence",
    f"WITH {SEARCH} SELECT document_type, side, name, count(*) AS documents, count(*) FILTER (matched) AS matched FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS document_type, '{s}' AS side, '{label}' AS name, {test} AS matched FROM search" for n, _, _, s, label, _, test in _evidence_rows())
    + ") GROUP BY 1, 2, 3",
)
def rule_evidence(t):
    """How often each piece of evidence of a run-time rule table is found."""
    flags = cls.evidence_flags(t.documents, rules(t), fuzzy=False)
    return flags.groupBy("document_type", "side", "name").agg(F.count(F.lit(1)).alias("documents"), F.count_if("matched").alias("matched"))


@query(
    "rule_rejects",
    "SELECT d.lang || '_' || r.document_type AS document_type, r.reason FROM (SELECT DISTINCT lang FROM documents) d, (VALUES ('BROKEN', 'invalid JSON'), ('EMPTY', 'evidence must have at least one entry'), ('HIGH', 'threshold must be between 0 and 1')) AS r(document_type, reason)",
)
def rule_rejects(t):
    """Rule rows of each language that cannot be used, with the reason."""
    languages = t.documents.select("lang").distinct()
    spoiled = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("position"), F.lit(on).alias("active"), F.lit(j).alias("rules_json")) for n, p, on, j in REJECTED])
    types = languages.select("lang", F.explode(spoiled).alias("r")).select(
        F.concat_ws("_", "lang", "r.n").alias("document_type"), "r.position", "r.active", "r.rules_json"
    )
    return load_rules(types)[1]


@query("classification_drift", f"WITH {BEST} SELECT doc_id, {RECORDED} AS recorded_type, coalesce(document_type, 'UNKNOWN') AS current_type FROM best WHERE {RECORDED} <> coalesce(document_type, 'UNKNOWN')")
def classification_drift(t):
    recorded = t.documents.select("doc_id", F.expr(RECORDED).alias("document_type"))
    return cls.classification_drift(recorded, cls.classify(t.documents, rules(t), fuzzy=False))


@query(
    "expected_vs_detected",
    f"WITH {BEST} SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN {RECORDED} <> coalesce(document_type, 'UNKNOWN') END AS divergent FROM best",
)
def expected_vs_detected(t):
    docs = t.documents.withColumn("expected_type", F.expr(f"CASE WHEN doc_id % 5 <> 0 THEN {RECORDED} END"))
    return cls.expected_divergence(cls.classify(docs, rules(t), fuzzy=False)).select("doc_id", "divergent")


@query("normalized_text", f"WITH {SEARCH} SELECT doc_id, sha256(trim(words)) AS words_digest, sha256(compact) AS compact_digest FROM search")
def normalized_text(t):
    normal = normalize_text(t.documents)
    return normal.select("doc_id", F.sha2("words", 256).alias("words_digest"), F.sha2("compact", 256).alias("compact_digest"))


LINES = (
    "broken AS (SELECT doc_id, source, regexp_replace(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g') AS body FROM documents WHERE text <> ''), "
    "listed AS (SELECT doc_id, source, string_split(CASE WHEN ends_with(body, chr(10)) THEN left(body, length(body) - 1) ELSE body END, chr(10)) AS parts FROM broken), "
    "lines AS (SELECT doc_id, source, unnest(parts) AS line, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_no FROM listed)"
)


@query("text_lines", f"WITH {LINES} SELECT doc_id, line_no, sha256(line) AS digest FROM lines")
def text_lines(t):
    return to_lines(t.documents).select("doc_id", "line_no", F.sha2("line", 256).alias("digest"))


@query(
    "duplicate_content",
    "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_content(t):
    return intake.duplicate_groups(intake.content_digest(t.documents, "text"))


# ---------------------------------------------------------------- privacy
# The texts carry no Brazilian numbers, so every document gets a last line with numbers derived from its key.

ALLOWED = [("CPF", "00000000191"), ("CEP", "01001000")]


def _sum(base: str, weights) -> str:
    return "(" + " + ".join(f"CAST(substr({base}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def number_stages(dialect: str, key: str) -> list[dict[str, str]]:
    """Right identifiers made from a key, one digit per stage, in SQL that both dialects read."""
    cpf = lambda base, ws: f"CAST(({_sum(base, ws)} * 10 % 11) % 10 AS {dialect})"
    cnpj = lambda base, ws: f"CAST((11 - {_sum(base, ws)} % 11) % 11 % 10 AS {dialect})"
    first = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    return [
        {"n9": f"lpad(CAST(({key} * 7907 + 1234567) % 1000000000 AS {dialect}), 9, '0')"},
        {"n10": f"concat(n9, {cpf('n9', range(10, 1, -1))})", "n12": "concat(substr(n9, 2, 8), '0001')"},
        {"cpf": f"concat(n10, {cpf('n10', range(11, 1, -1))})", "n13": f"concat(n12, {cnpj('n12', first)})"},
        {"cnpj": f"concat(n13, {cnpj('n13', (6, *first))})"},
    ]


def add_numbers(df, key: str):
    for stage in number_stages("STRING", key):
        df = df.withColumns({name: F.expr(text) for name, text in stage.items()})
    return df.drop("n9", "n10", "n12", "n13")


def numbers_sql(table: str, key: str, name: str) -> str:
    """CTE list that ends in ``name``: the table with cpf and cnpj columns."""
    parts, source = [], table
    stages = number_stages("VARCHAR", key)
    for number, stage in enumerate(stages):
        target = name if number == len(stages) - 1 else f"{name}_{number}"
        parts.append(f"{target} AS (SELECT *, " + ", ".join(f"{text} AS {column}" for column, text in stage.items()) + f" FROM {source})")
        source = target
    return ", ".join(parts)


def _dotted_cpf(v: str) -> str:
    return f"concat(substr({v}, 1, 3), '.', substr({v}, 4, 3), '.', substr({v}, 7, 3), '-', substr({v}, 10, 2))"


def _dotted_cnpj(v: str) -> str:
    return f"concat(substr({v}, 1, 2), '.', substr({v}, 3, 3), '.', substr({v}, 6, 3), '/', substr({v}, 9, 4), '-', substr({v}, 13, 2))"


_TAIL = (
    "concat('cpf ', CASE WHEN doc_id % 3 = 0 THEN cpf WHEN doc_id % 3 = 1 THEN " + _dotted_cpf("cpf") + " ELSE concat(substr(cpf, 1, 10), CAST((CAST(substr(cpf, 11, 1) AS INT) + 1) % 10 AS {s})) END, "
    "' cnpj ', CASE WHEN doc_id % 2 = 0 THEN cnpj ELSE " + _dotted_cnpj("cnpj") + " END, ' cep ', substr(cpf, 1, 5), '-', substr(cpf, 6, 3), ' rg ', substr(cpf, 1, 2), '.', substr(cpf, 3, 3), '.', substr(cpf, 6, 3), '-X nasc. 07/11/', CAST(1950 + doc_id % 60 AS {s}))"
)


def numbered_documents(t):
    """Documents with the line of numbers right behind their own lines; where there is no text, it is the only line."""
    docs = add_numbers(t.documents.selectExpr("doc_id", "concat('d', CAST(doc_id AS STRING)) AS path", "coalesce(text, '') AS body"), "doc_id")
    # A break at the end of a text ends its last line already; one more would make an empty line.
    ended = F.right("body", F.lit(1)).rlike(rf"^(?:{LINE_BREAK})?\z")
    return docs.select("doc_id", "path", "cpf", "cnpj", F.concat("body", F.when(ended, "").otherwise("\n"), F.expr(_TAIL.format(s="STRING"))).alias("text"))


NUMBERED_DOCS = (
    numbers_sql("documents", "doc_id", "base") + ", "
    "numbered AS (SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) AS path, cpf, cnpj, " + _TAIL.format(s="VARCHAR") + " AS tail FROM base)"
)


def _weights_sql(value: str, weights, start: int = 1) -> str:
    return "(" + " + ".join(f"(ascii(substr({value}, {start + i}, 1)) - 48) * {w}" for i, w in enumerate(weights)) + ")"


def cpf_valid_sql(v: str) -> str:
    d1, d2 = _weights_sql(v, range(10, 1, -1)), _weights_sql(v, range(11, 1, -1))
    return f"(len(list_distinct(string_split({v}, ''))) > 1 AND ({d1} * 10 % 11) % 10 = ascii(substr({v}, 10, 1)) - 48 AND ({d2} * 10 % 11) % 10 = ascii(substr({v}, 11, 1)) - 48)"


def cnh_valid_sql(v: str) -> str:
    a, b = f"({_weights_sql(v, range(9, 0, -1))} % 11)", f"({_weights_sql(v, range(1, 10))} % 11)"
    second = f"({b} - CASE WHEN {a} = 10 THEN 2 ELSE 0 END)"
    wrapped = f"(CASE WHEN {second} < 0 THEN {second} + 11 ELSE {second} END)"
    return f"(len(list_distinct(string_split({v}, ''))) > 1 AND CASE WHEN {a} > 9 THEN 0 ELSE {a} END = ascii(substr({v}, 10, 1)) - 48 AND CASE WHEN {wrapped} > 9 THEN 0 ELSE {wrapped} END = ascii(substr({v}, 11, 1)) - 48)"


def cnpj_valid_sql(v: str) -> str:
    d1, d2 = f"({_weights_sql(v, (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))} % 11)", f"({_weights_sql(v, (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))} % 11)"
    return f"(len(list_distinct(string_split(substr({v}, 1, 12), ''))) > 1 AND CASE WHEN {d1} < 2 THEN 0 ELSE 11 - {d1} END = ascii(substr({v}, 13, 1)) - 48 AND CASE WHEN {d2} < 2 THEN 0 ELSE 11 - {d2} END = ascii(substr({v}, 14, 1)) - 48)"


def voter_valid_sql(v: str) -> str:
    uf = f"CAST(substr({v}, 9, 2) AS INT)"
    r1 = f"({_weights_sql(v, (2, 3, 4, 5, 6, 7, 8, 9))} % 11)"
    d1 = f"(CASE WHEN {uf} IN (1, 2) AND {r1} = 0 THEN 1 WHEN {r1} = 10 THEN 0 ELSE {r1} END)"
    r2 = f"(({_weights_sql(v, (7, 8), 9)} + {d1} * 9) % 11)"
    d2 = f"(CASE WHEN {uf} IN (1, 2) AND {r2} = 0 THEN 1 WHEN {r2} = 10 THEN 0 ELSE {r2} END)"
    return f"(len(list_distinct(string_split({v}, ''))) > 1 AND {uf} BETWEEN 1 AND 28 AND {d1} = ascii(substr({v}, 11, 1)) - 48 AND {d2} = ascii(substr({v}, 12, 1)) - 48)"


def _findings_sql() -> str:
    """Findings by an independent reading: digit runs cut out with capture groups, borders checked by hand."""
    pick = "SELECT path, line_no, {kind} AS family, unnest(regexp_extract_all(line, '{shape}', {group})) AS hit FROM all_lines"
    padded = "SELECT path, line_no, ' ' || regexp_replace(line, '([^0-9.])', ' \\1 ', 'g') || ' ' AS line FROM all_lines"
    return (
        f"{NUMBERED_DOCS}, {LINES}, tails AS (SELECT n.path, n.tail AS line, coalesce(c.n, 0) + 1 AS line_no FROM numbered n LEFT JOIN (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY doc_id) c USING (doc_id)), "
        "all_lines AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS path, line_no, line FROM lines UNION ALL SELECT path, CAST(line_no AS INTEGER), line FROM tails), "
        f"runs AS ({padded}), tokens AS (SELECT path, line_no, unnest(string_split_regex(line, '[^0-9.]+')) AS token FROM runs), "
        "hits AS (SELECT path, line_no, 'ELEVEN' AS family, token AS raw FROM tokens WHERE regexp_full_match(token, '[0-9]{11}') "
        "UNION ALL SELECT path, line_no, 'CNPJ', token FROM tokens WHERE regexp_full_match(token, '[0-9]{14}') "
        "UNION ALL SELECT path, line_no, 'TITULO', token FROM tokens WHERE regexp_full_match(token, '[0-9]{12}') "
        "UNION ALL " + pick.format(kind="'ELEVEN'", shape="[0-9]{3}\\.[0-9]{3}\\.[0-9]{3}-[0-9]{2}", group=0) + " "
        "UNION ALL " + pick.format(kind="'CNPJ'", shape="[0-9]{2}\\.[0-9]{3}\\.[0-9]{3}/[0-9]{4}-[0-9]{2}", group=0) + " "
        "UNION ALL " + pick.format(kind="'CEP'", shape="(?:^|[^0-9])([0-9]{5}-[0-9]{3})(?:$|[^0-9])", group=1) + " "
        "UNION ALL " + pick.format(kind="'RG'", shape="(?:^|[^0-9])([0-9]{1,2}\\.[0-9]{3}\\.[0-9]{3}-[0-9Xx])(?:$|[^0-9])", group=1) + "), "
        "plain AS (SELECT path, line_no, family, CASE WHEN family = 'RG' THEN upper(regexp_replace(raw, '[.\\-]', '', 'g')) ELSE regexp_replace(raw, '[^0-9]', '', 'g') END AS v FROM hits), "
        f"findings AS (SELECT path, line_no, v, CASE WHEN family = 'ELEVEN' AND {cpf_valid_sql('v')} THEN 'CPF' WHEN family = 'ELEVEN' AND {cnh_valid_sql('v')} THEN 'registro de CNH' WHEN family = 'CNPJ' AND {cnpj_valid_sql('v')} THEN 'CNPJ' "
        f"WHEN family = 'TITULO' AND {voter_valid_sql('v')} THEN 'titulo de eleitor' WHEN family IN ('CEP', 'RG') THEN family END AS kind FROM plain WHERE NOT (family = 'ELEVEN' AND v = '00000000191') AND NOT (family = 'CEP' AND v = '01001000'))"
    )


FINDINGS = _findings_sql()


def _scanned(t):
    return to_lines(numbered_documents(t), "path")


def _allowed(t):
    return t.literal(ALLOWED, "kind string, value string")


@query("pii_findings", f"WITH {FINDINGS} SELECT path, line_no, kind, left(v, 3) || repeat('*', length(v) - 3) AS redacted FROM findings WHERE kind IS NOT NULL")
def pii_findings(t):
    return privacy.scan_pii(_scanned(t), _allowed(t))


@query("pii_summary", f"WITH {FINDINGS} SELECT path, kind, count(*) AS findings FROM findings WHERE kind IS NOT NULL GROUP BY 1, 2")
def pii_summary(t):
    return privacy.pii_summary(privacy.scan_pii(_scanned(t), _allowed(t)))


@query(
    "allow_list",
    f"WITH {FINDINGS} SELECT kind, count(*) AS findings, count(DISTINCT v) AS distinct_values FROM findings WHERE kind IS NOT NULL AND NOT (kind IN ('CPF', 'registro de CNH') AND v IN (SELECT cpf FROM numbered WHERE doc_id % 2 = 0)) GROUP BY 1",
)
def allow_list(t):
    """Known values of one kind also silence the other kind of the same length."""
    known = numbered_documents(t).filter("doc_id % 2 = 0").select(F.lit("registro de CNH").alias("kind"), F.col("cpf").alias("value"))
    allowed = _allowed(t).unionByName(known)
    found = privacy.find_values(_scanned(t))
    kept = found.join(privacy.allow_groups(allowed), ["allow_group", "value"], "left_anti")
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("value").alias("distinct_values"))


POOLS = {
    "CPF": ["11144477735", "52998224725", "39053344705"],
    "registro de CNH": ["12345678900", "98765432109"],
    "CNPJ": ["11222333000181", "11444777000161"],
    "CEP": ["01001000", "20040002", "30130010"],
    "RG": ["123456789", "987654321"],
}


# Made-up number with right check digits; texts have voters' numbers by chance only.
VOTERS = {privacy.KIND_VOTER: ["123456782895"]}


def _found(t):
    """Findings of all lines, stored, as the mask table and the masking itself both read them."""
    return cut_lineage(privacy.find_values(numbered_lines(t)).drop("line"))


def _masks(t, pools=POOLS, found=None):
    found = privacy.find_values(numbered_lines(t)) if found is None else found
    found = found.join(privacy.allow_groups(_allowed(t)), ["allow_group", "value"], "left_anti")
    return privacy.mask_table(found.filter(F.col("kind").isin(*pools)), pools, ["doc_id", "line_no", "scan", "at"])


def numbered_lines(t):
    return to_lines(numbered_documents(t), "doc_id")


@query(
    "pii_mask_map",
    f"WITH {FINDINGS}, firsts AS (SELECT kind, v, min((CAST(substr(path, 2) AS BIGINT), line_no)) AS seen FROM findings WHERE kind IN ('CNPJ', 'CEP') GROUP BY 1, 2), "
    "numbered_values AS (SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY seen) AS nth FROM firsts) "
    "SELECT kind, v AS value, CASE kind WHEN 'CNPJ' THEN ['11222333000181', '11444777000161'][(nth - 1) % 2 + 1] ELSE ['01001000', '20040002', '30130010'][(nth - 1) % 3 + 1] END AS replacement FROM numbered_values",
)
def pii_mask_map(t):
    """Which pool value stands in for which real value: by order of first appearance."""
    return _masks(t).filter(F.col("kind").isin("CNPJ", "CEP"))


@query("pii_masked_lines", f"WITH {FINDINGS} SELECT CAST(substr(path, 2) AS BIGINT) AS doc_id, count(DISTINCT line_no) AS changed FROM findings WHERE kind IS NOT NULL AND kind <> 'titulo de eleitor' GROUP BY 1")
def pii_masked_lines(t):
    """Lines that masking changes, per document."""
    allowed, found = _allowed(t), _found(t)
    masked = privacy.mask_lines(numbered_lines(t), _masks(t, found=found), allowed, keys=("doc_id", "line_no"), found=found)
    return masked.filter(F.col("masked") != F.col("line")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("changed"))


@query("pii_residual", "SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS INTEGER) AS line_no, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS redacted FROM documents WHERE false")
def pii_residual(t):
    """Masked text scanned again with the pools as known values: nothing is left."""
    pools, found = POOLS | VOTERS, _found(t)
    masked = privacy.mask_lines(numbered_lines(t), _masks(t, pools, found), _allowed(t), keys=("doc_id", "line_no"), found=found)
    known = _allowed(t).unionByName(t.literal([(k, v) for k, vs in pools.items() for v in vs], "kind string, value string"))
    return privacy.residual_check(masked, known, key="doc_id")


@query(
    "name_scan",
    f"WITH {LINES}, names AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT unnest(string_split(text, chr(10))) FROM benchmark UNION SELECT DISTINCT n_name FROM nation), "
    f"f AS (SELECT doc_id, line_no, regexp_replace(translate(line, {sql_text(fold_table('NFKD')[0])}, {sql_text(fold_table('NFKD')[1])}), '\\p{{Mn}}+', '', 'g') AS line FROM lines), "
    f"g AS (SELECT trim(name) AS name, translate(trim(name), {sql_text(fold_table('NFKD')[0])}, {sql_text(fold_table('NFKD')[1])}) AS folded FROM names) "
    "SELECT doc_id, line_no, 'nome real' AS kind, 'contem ''' || left(name, 2) || '...''' AS redacted FROM f JOIN g ON contains(f.line, g.folded)",
)
def name_scan(t):
    names = t.part.select(F.col("p_brand").alias("name")).union(t.benchmark.select(F.explode(F.split("text", "\n")))).union(t.nation.select("n_name"))
    return privacy.scan_names(to_lines(t.documents), names, key="doc_id")
