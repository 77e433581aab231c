"""Regular-expression matches with their places in a text, as column expressions and as a SQL table function.

A text is cut at the matches; lengths of the parts add up to offsets. No marks are put into the text, so any characters
may stand in it. Patterns must match one character at least.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PARTS = "array<struct<gap:string,match:string>>"


def cut_at(text: Column, pattern: str) -> Column:
    """array<struct<gap, match>>: what stands before each match, and the match; the last one has the rest and no match."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))


def replace_matches(text: Column, pattern: str, change) -> Column:
    """The text with every match replaced by ``change(match)``; a replacement is not looked at again."""
    parts = F.transform(cut_at(text, pattern), lambda p: F.concat(p["gap"], F.coalesce(change(p["match"]), F.lit(""))))
    return F.when(text.isNotNull(), F.array_join(parts, ""))


def regex_offsets(text: Column, pattern: str) -> Column:
    """array<struct<value, start, finish>> of every match; offsets count characters from 0."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int,finish:int>>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        start = s["at"] + F.length(part["gap"])
        finish = start + F.length(part["match"])
        item = F.struct(part["match"].alias("value"), start.alias("start"), finish.alias("finish"))
        return F.struct(F.coalesce(finish, start).alias("at"), F.when(part["match"].isNotNull(), F.concat(s["found"], F.array(item))).otherwise(s["found"]).alias("found"))

    return F.aggregate(cut_at(text, pattern), state, step, lambda s: s["found"])


def register_sql(spark: SparkSession, name: str = "regex_offsets") -> None:
    """Makes ``LATERAL name(text, pattern)`` callable from SQL: rows (value, start, finish)."""
    parts = "zip_with(split(text, pattern, -1), regexp_extract_all(text, pattern, 0), (gap, m) -> named_struct('gap', gap, 'm', m))"
    item = "named_struct('value', p.m, 'start', s.at + length(p.gap), 'finish', s.at + length(p.gap) + length(p.m))"
    step = f"named_struct('at', s.at + length(p.gap) + coalesce(length(p.m), 0), 'found', if(p.m IS NULL, s.found, concat(s.found, array({item}))))"
    start = "named_struct('at', 0, 'found', cast(array() AS array<struct<value:string,start:int,finish:int>>))"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING, pattern STRING) RETURNS TABLE(value STRING, start INT, finish INT) "
        f"RETURN SELECT m.value, m.start, m.finish FROM (SELECT explode(aggregate({parts}, {start}, (s, p) -> {step}, s -> s.found)) AS m)"
    )
