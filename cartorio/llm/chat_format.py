"""Chat formatting with budgeted windows, built-in functions only.

A turn is written as ``<s>role<r>text</s>``. Control strings start with ``<``; inside a role or a text every
``<``, ``[`` and ``\\`` is followed by a backslash that the reader takes away, so neither these marks nor those
of other templates (``[INST]``) can arise from a text.

Windows are chosen by prefix sums of turn sizes in words: a turn belongs to the span of its conversation in
which its first word falls, spans being half the budget wide less the system turn. A window is the system turn, the turns of
the span before that start at most ``history`` words earlier, and the turns of the span. Only turns of its own
span are new in a window; the loss mask covers the assistant texts among them, so each is a target once. A
window exceeds the budget only where one turn alone exceeds half of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<s>", "<r>", "</s>"
BUDGET, HISTORY = 512, 96


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "([<\\[\\\\])", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "([<\\[\\\\])\\\\", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MID), text, F.lit(CLOSE))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows (conv_id, window, n_repeated, formatted, loss_mask) of the turns (conv_id, turn, role, text).

    ``loss_mask`` is an array of (start, length) in characters of ``formatted``, starts counted from 1;
    ``n_repeated`` says how many turns at the start were in an earlier window. Turns go by (turn, role, text), so
    ties and repeated rows are all kept, in a set order. The system turn is the first one, if its role is system.
    Null role or text: empty. Null is a conversation like others; an empty table gives an empty one; other
    columns are ignored. A turn counts one more than its words, so a window holds a bounded number of turns.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("cost", F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long") + 1)
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        (F.sum("cost").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cost")).alias("before"),
        F.first(F.when(F.col("role") == "system", F.struct("text", "cost"))).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("head"),
        "role",
        "text",
    )
    wide = F.greatest(F.lit(1), F.floor((F.lit(budget) - F.coalesce("head.cost", F.lit(0))) / 2))
    rows = rows.withColumn("span", F.floor(F.col("before") / wide).cast("long"))
    # Windows are numbered without gaps: a span in which no turn begins is none.
    rows = rows.withColumn("window", F.dense_rank().over(W.partitionBy("conv_id").orderBy("span")).cast("long"))
    after = F.min("before").over(W.partitionBy("conv_id").orderBy("window").rangeBetween(1, 1))
    rows = rows.withColumn("after", after)
    own = rows.select("conv_id", "window", "place", F.lit(False).alias("repeated"), "role", "text")
    headless = ~((F.col("place") == 1) & F.col("head").isNotNull())
    past = rows.filter(headless & (F.col("after") - F.col("before") <= history)).select("conv_id", (F.col("window") + 1).alias("window"), "place", F.lit(True).alias("repeated"), "role", "text")
    heads = rows.filter((F.col("window") > 1) & F.col("head").isNotNull()).groupBy("conv_id", "window").agg(F.first("head.text").alias("text"))
    heads = heads.select("conv_id", "window", F.lit(0).alias("place"), F.lit(True).alias("repeated"), F.lit("system").alias("role"), "text")
    every = own.unionByName(past).unionByName(heads).select("conv_id", "window", "place", "repeated", "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    every = every.withColumn("turn", rendered(F.col("r"), F.col("t")))
    within = W.partitionBy("conv_id", "window").orderBy("place")
    begin = F.sum(F.length("turn")).over(within.rowsBetween(W.unboundedPreceding, 0)) - F.length("turn")
    start = (begin + 1 + len(OPEN) + F.length("r") + len(MID)).cast("int")
    target = F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.struct(start.alias("start"), F.length("t").alias("length")))
    every = every.select("conv_id", "window", "place", "repeated", "turn", target.alias("target"))
    gathered = every.groupBy("conv_id", "window").agg(
        F.sum(F.col("repeated").cast("long")).alias("n_repeated"), F.sort_array(F.collect_list(F.struct("place", "turn", "target"))).alias("turns")
    )
    return gathered.select(
        "conv_id",
        "window",
        "n_repeated",
        F.array_join("turns.turn", "").alias("formatted"),
        F.array_compact("turns.target").alias("loss_mask"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Windows with ``turns`` (role, text), new ones only, and ``losses``, the texts under the loss mask; escapes undone."""
    parts = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    mid = F.lit(MID)
    turns = F.transform(
        F.slice(parts, F.col("n_repeated").cast("int") + 1, F.size(parts)),
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, MID, 1), len(OPEN) + 1, 1 << 30)).alias("role"),
            unescape(F.substring(p, F.instr(p, mid) + len(MID), F.length(p))).alias("text"),
        ),
    )
    losses = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"], m["length"])))
    return windows.select("conv_id", "window", "formatted", turns.alias("turns"), losses.alias("losses"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation what is read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    The digest of a conversation is over all its text, so its windows meet in one row here; the windows
    themselves need no such row.
    """
    read = read_windows(windows).select(
        "conv_id",
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("losses", "").alias("losses"),
        F.length("formatted").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.sort_array(F.collect_list(F.struct("window", "turns", "losses"))).alias("w")
    )
    losses = F.array_join("w.losses", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.length(losses).cast("long").alias("loss_chars"),
        F.sha2(losses, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
k AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS cost,
  {len(OPEN + MID + CLOSE)} + length(role) + length(text) + len(regexp_extract_all(role || text, '[<\\[\\\\]')) AS chars,
  row_number() OVER o AS place FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, sum(cost) OVER o - cost AS before, first_value(CASE WHEN role = 'system' THEN cost END) OVER o AS head, first_value(chars) OVER o AS head_chars
  FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
w AS (SELECT *, floor(before / greatest(1, floor(({BUDGET} - coalesce(head, 0)) / 2)))::BIGINT AS span FROM s),
d AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY span) AS win FROM w),
a AS (SELECT *, min(before) OVER (PARTITION BY conv_id ORDER BY win RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS after FROM d),
f AS (SELECT conv_id, sum(chars) + sum(CASE WHEN NOT (place = 1 AND head IS NOT NULL) AND after - before <= {HISTORY} THEN chars ELSE 0 END)
  + (max(win) - 1) * coalesce(max(CASE WHEN head IS NOT NULL THEN head_chars END), 0) AS formatted_chars, max(win) AS n_windows FROM a GROUP BY conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  max(f.formatted_chars)::BIGINT AS formatted_chars, max(n_windows)::BIGINT AS n_windows FROM k JOIN f USING (conv_id) GROUP BY conv_id
"""
