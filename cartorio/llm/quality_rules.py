"""Quality rules: a threshold table compiled into one projection over whole texts, built-in functions only.

A rule bounds a ratio of two counts in hundredths; ratios are compared by cross multiplication in whole
numbers. Words are runs of characters other than blank, tab, line feed, vertical tab, form feed, carriage return.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages in use. A text of sentences has some of them.
STOP_WORDS = [
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu", "im",
    "au", "avec", "dans", "de", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "un", "une",
    "al", "con", "del", "el", "es", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
]


@dataclass(frozen=True)
class Rule:
    """100 * ``count`` must lie between ``least`` and ``most`` times ``of`` (None: no bound)."""

    name: str
    count: str
    of: str
    least: int | None = None
    most: int | None = None


#: What a text has to meet besides the base rules.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols_per_word", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=3),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
)
MIN_WORDS, MAX_REPEAT = 50, 50


def behind(df: DataFrame, names: list[str], columns: list[Column]) -> DataFrame:
    """``names`` and ``columns`` worked out once a row: a filter or projection above a generator can't be merged into them."""
    return df.select(*[df[f"`{c}`"] for c in names], F.inline(F.array(F.struct(*columns))))


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the counts that rules may name.

    n_words, word_chars, n_symbols, n_stop_words, n_lines (lines with a word), n_dup_lines (equal to an earlier
    one) and n_repeat_words (words in 3-word windows that occur twice or more). Null counts as empty: all 0.
    Input columns of these names are replaced, all others are kept, whatever their names. Windows are compared by
    64-bit hashes.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in made]
    free = "_"  # begins no name of the row, so that names made here meet no others
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    text_, words_, lines_, windows_ = (free + n for n in ("text", "words", "lines", "windows"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = F.btrim(body, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    # What a lambda reads must be a value of the row below: merged into the lambda, it would be worked out for every element.
    first = behind(docs, kept, [body.alias(text_), words.alias(words_), lines.alias(lines_)])
    n = F.size(words_)
    windows = F.when(n < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get(words_, i), F.get(words_, i + 1), F.get(words_, i + 2)).alias("h"), i.alias("i")),
        )
    )
    counts = [
        n.cast("long").alias("n_words"),
        F.length(F.translate(text_, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text_) - F.length(F.translate(text_, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter(words_, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines_).cast("long").alias("n_lines"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias(windows_),
    ]
    second = behind(first, kept, counts)

    def same(a: Column, b: Column) -> Column:
        return a["h"] == b["h"]

    again = F.filter(
        windows_,
        lambda x, i: F.coalesce(same(x, F.get(windows_, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(windows_, i + 1)), F.lit(False)),
    )
    starts = F.sort_array(F.transform(again, lambda x: x["i"].cast("long")))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return behind(second, [*kept, *made[:-1]], [covered.alias("n_repeat_words")])


def passes(rule: Rule) -> Column:
    parts = [100 * F.col(rule.count) >= F.lit(rule.least) * F.col(rule.of)] if rule.least is not None else []
    parts += [100 * F.col(rule.count) <= F.lit(rule.most) * F.col(rule.of)] if rule.most is not None else []
    verdict = parts[0]
    for part in parts[1:]:
        verdict = verdict & part
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the counts of ``metrics``, base_failed, failed_rules (names in table order) and kept."""
    measured = metrics(docs, text)
    failed = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    every = F.lit(True)
    for rule in rules:
        every = every & passes(rule)
    rest = [f"`{c}`" for c in measured.columns if c not in ("base_failed", "failed_rules", "kept")]
    return measured.select(*rest, base.alias("base_failed"), failed.alias("failed_rules"), (~base & every).alias("kept"))


def _sql_rule(rule: Rule) -> str:
    parts = [f"100 * {rule.count} >= {rule.least} * {rule.of}"] if rule.least is not None else []
    parts += [f"100 * {rule.count} <= {rule.most} * {rule.of}"] if rule.most is not None else []
    return " AND ".join(parts)


def oracle_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM base),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM p),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM c WHERE k > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(ws, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {" AND ".join(_sql_rule(r) for r in RULES)}) AS kept, n_stop_words, n_lines FROM b
"""
