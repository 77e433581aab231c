"""Rule classification of documents: scores, winner, explanation, drift.

A row carries its whole decision: patterns are looked up in the row's own text, scores are sums of
constants, and the winner is the head of a sorted array. Nothing is shuffled. A catalogue beyond the size for
plan constants is matched by joins, with the same columns and rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartorio.bounds import hint_small
from cartorio.functions import pieces
from cartorio.functions.approximate import LETTERS_PER_EDIT, MAX_EDITS, SUBSTRING_LENGTH, budget, edits_within, patterns_within, search_patterns
from cartorio.functions.expressions import bind, first_case, round_even, text_array
from cartorio.functions.folding import compact_of, fold, words_of
from cartorio.functions.pieces import BEGINNING, piece_list, pieces_in
from cartorio.sources.rules import Evidence, Profile, collect_profiles, pattern_rows

UNKNOWN = "UNKNOWN"
VERSION = "rules-2.0.0"
SCORE = "decimal(5,4)"


def _prepared(docs: DataFrame, profiles: list[Profile], text: str, fuzzy: bool) -> tuple[DataFrame, dict[int, int]]:
    """Adds the searchable columns; returns the number of each long pattern in the approximate scan."""
    folded = docs.withColumn("_folded", fold(F.col(text)))
    ready = folded.withColumn("_compact", compact_of(F.col("_folded"))).withColumn(
        "_words", F.concat(F.lit(" "), words_of(F.col("_folded")), F.lit(" "))
    )
    numbers: dict[int, int] = {}
    if fuzzy:
        distinct: dict[str, int] = {}
        for profile in profiles:
            for pattern in profile.patterns:
                if len(pattern.compact) >= SUBSTRING_LENGTH:
                    numbers[pattern.id] = distinct.setdefault(pattern.compact, len(distinct))
        ready = ready.withColumn("_edits", search_patterns(F.col("_compact"), list(distinct)))
    return ready.drop("_folded"), numbers


def _edits(pattern, numbers: dict[int, int]) -> Column:
    """Edits of a pattern in the row's text, null when it is not there."""
    if not pattern.compact:
        return F.lit(None).cast("int")
    if len(pattern.compact) < SUBSTRING_LENGTH:
        return F.when(F.col("_words").contains(f" {pattern.words} "), 0)
    if pattern.id in numbers:
        return F.try_element_at("_edits", F.lit(numbers[pattern.id]))
    return F.when(F.col("_compact").contains(pattern.compact), 0)


def _constants(profiles: list[Profile], minimum: Decimal | None) -> Column:
    """The catalogue as one constant array; patterns are named by their place in the list of lookups."""
    place = {p.id: n for n, p in enumerate(p for profile in profiles for p in profile.patterns)}
    item = "array<struct<name:string,weight:decimal(12,6),patterns:array<string>,places:array<int>>>"

    def items(block: list[Evidence]) -> Column:
        rows = [
            F.struct(
                F.lit(e.name).alias("name"), F.lit(e.weight).alias("weight"),
                text_array(p.text for p in e.patterns).alias("patterns"),
                F.array(*[F.lit(place[p.id]) for p in e.patterns]).cast("array<int>").alias("places"),
            )
            for e in block
        ]
        return F.array(*rows).cast(item)

    return F.array(
        *[
            F.struct(
                F.lit(order).alias("position"), F.lit(p.document_type).alias("document_type"),
                F.lit(minimum or p.threshold).cast("decimal(12,6)").alias("threshold"),
                items(p.evidence).alias("evidence"), items(p.counter).alias("counter"),
            )
            for order, p in enumerate(profiles)
        ]
    )


def _looked_up(items: Column, found: Column) -> Column:
    """Evidence with the first of its patterns that was found."""
    def one(item: Column) -> Column:
        hits = F.filter(F.arrays_zip(item["patterns"].alias("pattern"), item["places"].alias("place")), lambda z: F.get(found, z["place"]).isNotNull())
        first = F.get(F.transform(hits, lambda z: F.struct(z["pattern"].alias("pattern"), F.get(found, z["place"]).alias("edits"))), F.lit(0))
        return bind(
            first,
            lambda h: F.struct(
                item["name"].alias("name"), item["weight"].alias("weight"), h.isNotNull().alias("matched"),
                h["pattern"].alias("pattern"), F.when(h["edits"] == 0, "EXACT").when(h["edits"] > 0, "FUZZY").alias("kind"),
                h["edits"].alias("edits"),
            ),
        )

    return F.transform(items, one)


def _total(items: Column) -> Column:
    zero = F.lit(Decimal(0)).cast("decimal(20,6)")
    return F.aggregate(items, zero, lambda s, i: (s + F.when(i["matched"], i["weight"]).otherwise(0)).cast("decimal(20,6)"))


def _judged(c: Column) -> Column:
    """A candidate with its score; candidates sort best first."""
    raw = _total(c["evidence"]) - _total(c["counter"])
    clamped = round_even(F.greatest(F.least(raw, F.lit(Decimal(1))), F.lit(Decimal(0))), 4).cast(SCORE)
    return bind(
        clamped,
        lambda score: F.struct(
            (-score).alias("sort"), c["position"].alias("position"), c["document_type"].alias("document_type"),
            score.alias("score"), c["threshold"].alias("threshold"), (score >= c["threshold"]).alias("accepted"),
            c["evidence"].alias("evidence"), c["counter"].alias("counter"),
        ),
    )


def evidence_flags(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", fuzzy: bool = True) -> DataFrame:
    """One row per document, type and evidence with its matched flag."""
    lookups = candidates_of(docs, rules, key, text, fuzzy)
    sides = [
        lookups.select(key, "c.document_type", F.lit(side).alias("side"), F.explode_outer(f"c.{column}").alias("e")).filter("e IS NOT NULL")
        for side, column in (("E", "evidence"), ("C", "counter"))
    ]
    return sides[0].unionByName(sides[1]).select(key, "document_type", "side", "e.*")


def _scored(docs: DataFrame, rules: DataFrame, text: str, minimum: Decimal | None, fuzzy: bool) -> DataFrame:
    """Adds ``_candidates``, best first, and ``text_length``."""
    profiles = collect_profiles(rules)
    if profiles is None:
        return _scored_by_join(docs, rules, text, minimum, fuzzy)
    ready, numbers = _prepared(docs, profiles, text, fuzzy)
    # Every pattern is looked up once, in this array; all the rest works on the few results.
    lookups = F.array(*[_edits(p, numbers) for profile in profiles for p in profile.patterns]).cast("array<int>")
    found = ready.withColumn("_found", lookups).withColumn("text_length", F.length("_compact")).drop("_words", "_compact", "_edits")

    def scored(hits: Column) -> Column:
        looked = F.transform(
            _constants(profiles, minimum),
            lambda p: F.struct(
                p["position"].alias("position"), p["document_type"].alias("document_type"), p["threshold"].alias("threshold"),
                _looked_up(p["evidence"], hits).alias("evidence"), _looked_up(p["counter"], hits).alias("counter"),
            ),
        )
        return F.array_sort(F.transform(looked, _judged))

    return found.withColumn("_candidates", bind(F.col("_found"), scored)).drop("_found")


def _with_winner(scored: DataFrame) -> DataFrame:
    """Adds the winner; a text without letters or digits has none, as no evidence can match it."""
    return scored.withColumn("_winner", F.get(F.filter("_candidates", lambda c: c["accepted"]), F.lit(0)))


def classify(
    docs: DataFrame, rules: DataFrame, minimum: Decimal | None = None, key: str = "doc_id", text: str = "text", fuzzy: bool = True
) -> DataFrame:
    """Type or UNKNOWN, score, matched evidence and version per document.

    A catalogue beyond the size for plan constants goes through joins.
    """
    if collect_profiles(rules) is None:
        return _won_by_join(docs, rules, minimum, text, fuzzy).withColumn("classifier", F.lit(VERSION))
    won = _with_winner(_scored(docs, rules, text, minimum, fuzzy))
    names = F.transform(F.filter("_winner.evidence", lambda e: e["matched"]), lambda e: e["name"])
    return won.withColumns(
        {
            "document_type": F.coalesce("_winner.document_type", F.lit(UNKNOWN)),
            "score": F.col("_winner.score"),
            "signals": F.coalesce(names, F.array().cast("array<string>")),
            "classifier": F.lit(VERSION),
        }
    ).drop("_winner", "_candidates", "text_length")


def _two(value: Column) -> Column:
    return F.format_string("%.2f", value.cast("double"))


def _candidate_reason(c: Column) -> Column:
    """The sentence that says why a candidate was accepted or not."""
    names = lambda items: F.transform(items, lambda i: i["name"])
    found = F.filter(c["evidence"], lambda i: i["matched"])
    missing = F.filter(c["evidence"], lambda i: ~i["matched"])
    against = F.filter(c["counter"], lambda i: i["matched"])
    worth = F.aggregate(missing, F.lit(Decimal(0)).cast("decimal(20,6)"), lambda s, i: (s + i["weight"]).cast("decimal(20,6)"))
    penalties = F.transform(against, lambda i: F.concat(i["name"], F.lit(" (-"), _two(i["weight"]), F.lit(")")))
    head = F.when(
        c["accepted"], F.concat(F.lit("Score "), _two(c["score"]), F.lit(" reached the threshold "), _two(c["threshold"]), F.lit("."))
    ).otherwise(
        F.concat(
            F.lit("Score "), _two(c["score"]), F.lit(" is below the threshold "), _two(c["threshold"]),
            F.lit(" (short by "), _two(c["threshold"] - c["score"]), F.lit(")."),
        )
    )
    return F.concat_ws(
        " ",
        head,
        F.when(F.size(found) == 0, "No evidence found.").otherwise(F.concat(F.lit("Found: "), F.array_join(names(found), ", "), F.lit("."))),
        F.when(F.size(against) > 0, F.concat(F.lit("Counter-evidence lowered the score: "), F.array_join(penalties, ", "), F.lit("."))),
        F.when(
            ~c["accepted"] & (F.size(missing) > 0),
            F.concat(F.lit("Not found (worth up to "), _two(worth), F.lit("): "), F.array_join(names(missing), ", "), F.lit(".")),
        ),
    )


def candidates_of(
    docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", fuzzy: bool = True, minimum: Decimal | None = None
) -> DataFrame:
    scored = _scored(docs, rules, text, minimum, fuzzy)
    return scored.select(key, F.explode_outer("_candidates").alias("c"))


def explain_classification(
    docs: DataFrame, rules: DataFrame, minimum: Decimal | None = None, key: str = "doc_id", text: str = "text", fuzzy: bool = True
) -> DataFrame:
    """One row per document and candidate, best first, with evidence detail and the reasons."""
    won = _with_winner(_scored(docs, rules, text, minimum, fuzzy))
    long = won.select(key, "text_length", "_winner", F.size("_candidates").alias("tried"), F.posexplode_outer("_candidates").alias("rank", "c"))
    chosen = F.col("c.document_type") == F.col("_winner.document_type")
    late = F.col("c.accepted") & ~F.coalesce(chosen, F.lit(False))
    reason = F.concat(
        _candidate_reason(F.col("c")),
        F.when(
            late,
            F.concat(F.lit(" Not chosen: "), F.col("_winner.document_type"), F.lit(" scored higher ("), _two(F.col("_winner.score")), F.lit(").")),
        ).otherwise(""),
    )
    return long.select(
        key,
        (F.col("rank") + 1).alias("rank"),
        "c.document_type",
        "c.score",
        F.col("c.threshold").cast(SCORE).alias("threshold"),
        "c.accepted",
        F.coalesce(chosen, F.lit(False)).alias("chosen"),
        F.col("c.evidence").alias("evidence"),
        F.col("c.counter").alias("counter"),
        reason.alias("reason"),
        "text_length",
        "tried",
    )


def decisions(explained: DataFrame, key: str = "doc_id") -> DataFrame:
    """The sentence about the whole decision, from the winner or the closest candidate."""
    winner = F.min(F.when(F.col("chosen"), F.struct("rank", "document_type", "score", "threshold")))
    closest = F.min(F.struct("rank", "document_type", "score", "threshold"))
    summed = explained.groupBy(key).agg(
        winner.alias("w"), closest.alias("c"), F.max("text_length").alias("text_length"), F.max("tried").alias("tried")
    )
    text = first_case(
        [
            (
                F.col("w").isNotNull(),
                F.concat(
                    F.col("w.document_type"), F.lit(" chosen with score "), _two(F.col("w.score")), F.lit(" (threshold "),
                    _two(F.col("w.threshold")), F.lit("), best of "), F.col("tried").cast("string"), F.lit(" types tried."),
                ),
            ),
            (F.col("text_length") == 0, "The text is empty, so there was nothing to classify."),
            (F.col("c.score") <= 0, "No evidence of any known type was found in the text."),
        ],
        F.concat(
            F.lit("No type reached its threshold. Closest: "), F.col("c.document_type"), F.lit(" with score "),
            _two(F.col("c.score")), F.lit(" of "), _two(F.col("c.threshold")), F.lit("."),
        ),
    )
    return summed.select(key, F.coalesce("w.document_type", F.lit(UNKNOWN)).alias("document_type"), F.col("w.score").alias("score"), text.alias("reason"))


def classification_drift(recorded: DataFrame, current: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose recorded type differs from what today's rules say."""
    then = recorded.select(key, F.col("document_type").alias("recorded_type"))
    now = current.select(key, F.col("document_type").alias("current_type"))
    return then.join(now, key).filter(~F.col("recorded_type").eqNullSafe(F.col("current_type")))


def expected_divergence(classified: DataFrame, expected: str = "expected_type") -> DataFrame:
    """Details text of a classification and the flag that the expected type is another one (null without one)."""
    given = F.when(F.trim(expected) != "", F.col(expected))
    divergent = given != F.col("document_type")
    details = F.concat_ws(
        " ",
        F.concat(F.lit("type="), F.col("document_type")),
        F.concat(F.lit("confidence="), F.coalesce(F.regexp_replace(F.col("score").cast("string"), r"\.?0+$", ""), F.lit("none"))),
        F.concat(F.lit("signals="), F.size("signals").cast("string")),
        F.concat(F.lit("classifier="), F.col("classifier")),
        F.concat(F.lit("expected="), given),
        F.concat(F.lit("divergent="), divergent.cast("string")),
    )
    return classified.withColumns({"divergent": divergent, "details": details})


# ---------------------------------------------------------------- containment against large lists


def grams(text: Column, size: int) -> Column:
    """All overlapping windows of a size, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def contains_join(
    texts: DataFrame, patterns: DataFrame, text: str = "compact", pattern: str = "pattern_compact", gram: int = 8, on: Sequence[str] = ()
) -> DataFrame:
    """Text rows paired with the patterns they contain, for pattern lists of any size.

    Both sides meet on the first ``gram`` letters of the pattern. Up to the size for tasks, a text is searched for all of
    these beginnings in one pass, and only those that it has become rows. Beyond, a text offers every distinct
    window of that length under its hash, so the windows travel without the text, and the text is
    fetched by hash only for true prefixes. Equal hashes of different texts do no harm, as every
    pair is compared in the end. Patterns shorter than a gram are not handled here.
    """
    long = patterns.filter(F.length(pattern) >= gram)
    # Longer beginnings are in fewer texts; windows of several lengths cost little there.
    wanted = long.withColumn("_gram", F.substring(pattern, 1, max(gram, BEGINNING)))
    listed = piece_list(wanted, "_gram")
    if listed is not None:
        offered = texts.withColumn("_gram", F.explode_outer(pieces_in(F.col(text), listed))).withColumn("_gram", F.col("_gram.piece"))
        return offered.join(hint_small(wanted.distinct()), [*on, "_gram"]).filter(F.col(text).contains(F.col(pattern))).drop("_gram")
    wanted = long.withColumn("_gram", F.substring(pattern, 1, gram))
    hash_ = F.xxhash64(text)
    offered = texts.select(*on, hash_.alias("_hash"), F.explode_outer(F.array_distinct(grams(F.col(text), gram))).alias("_gram"))
    met = offered.join(hint_small(wanted), [*on, "_gram"]).drop("_gram").distinct()
    return texts.withColumn("_hash", hash_).join(met, [*on, "_hash"]).filter(F.col(text).contains(F.col(pattern))).drop("_hash")


def fuzzy_join(texts: DataFrame, patterns: DataFrame, on: str) -> DataFrame:
    """(``on``, pattern_compact, edits) of long patterns that are in ``compact`` within their budget, for lists of any size.

    Up to the size for tasks, a text is searched for all patterns in one pass, and the rows of a key are put together. Beyond,
    both sides meet on the first letters, up to eight, of one of the pieces of which one must occur unchanged.
    """
    names = piece_list(patterns.filter(F.length("pattern_compact") >= SUBSTRING_LENGTH), "pattern_compact")
    if names is not None and sum(budget(n) + 1 for n in names) <= pieces.PIECES_LIMIT:
        found = texts.select(on, F.explode(patterns_within(F.col("compact"), names)).alias("_f")).select(on, F.col("_f.pattern").alias("pattern_compact"), "_f.edits")
        return found.groupBy(on, "pattern_compact").agg(F.min("edits").alias("edits"))
    size = F.length("pattern_compact")
    count = F.least(F.lit(MAX_EDITS), F.floor(size / LETTERS_PER_EDIT).cast("int")) + 1
    cut = lambda i: F.floor(size * i / count).cast("int")
    piece = lambda i: F.substring(F.col("pattern_compact"), cut(i) + 1, F.least(F.lit(8), cut(i + 1) - cut(i)))
    wanted = patterns.select("pattern_compact").distinct().withColumn("_gram", F.explode_outer(F.transform(F.sequence(F.lit(0), count - 1), piece)))
    listed = piece_list(wanted, "_gram")
    if listed is not None:
        offered = texts.select(on, F.explode_outer(pieces_in(F.col("compact"), listed)).alias("_gram")).withColumn("_gram", F.col("_gram.piece"))
    else:
        # A piece of a pattern of eight letters has four; only windows as long as some piece are made.
        sizes = [r[0] for r in wanted.select(F.length("_gram")).distinct().collect()]
        windows = F.concat(*[grams(F.col("compact"), n) for n in sorted(sizes)])
        offered = texts.select(on, F.explode_outer(F.array_distinct(windows)).alias("_gram"))
    met = offered.join(hint_small(wanted), "_gram").select(on, "pattern_compact").distinct()
    # Not deterministic: else the filter would be merged into it, and pairs be compared twice.
    edits = F.pandas_udf(edits_within, "int").asNondeterministic()
    pairs = texts.select(on, "compact").dropDuplicates([on]).join(met, on)
    return pairs.select(on, "pattern_compact", edits("compact", "pattern_compact").alias("edits")).filter("edits IS NOT NULL")


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_text_id``: joins meet on texts, so that keys may be null or repeated."""
    return docs.withColumn("_text_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _matches(docs: DataFrame, rules: DataFrame, text: str, fuzzy: bool) -> DataFrame:
    """Pattern rows found in the texts: ``_text_id``, the columns of the pattern, and its edits."""
    patterns = pattern_rows(rules)
    folded = docs.select("_text_id", fold(F.col(text)).alias("folded"))
    searchable = folded.select("_text_id", compact_of(F.col("folded")).alias("compact"), words_of(F.col("folded")).alias("words"))
    long = patterns.filter(F.length("pattern_compact") >= SUBSTRING_LENGTH)
    short = patterns.filter(F.length("pattern_compact").between(1, SUBSTRING_LENGTH - 1))
    columns = ["_text_id", "document_type", "position", "threshold", "side", "ordinal", "weight", "name", "pattern_ordinal", "pattern"]
    if not fuzzy:
        found = _found_at_once(searchable, long, short)
        if found is not None:
            return found.select(*columns, F.lit(0).alias("edits"))
        close = contains_join(searchable, long).withColumn("edits", F.lit(0))
    else:
        close = fuzzy_join(searchable, long, "_text_id").join(hint_small(long), "pattern_compact")
    return close.select(*columns, "edits").unionByName(_word_runs(searchable, short).select(*columns, F.lit(0).alias("edits")))


def _framed(words: Column) -> Column:
    return F.concat(F.lit(" "), words, F.lit(" "))


def _found_at_once(searchable: DataFrame, long: DataFrame, short: DataFrame) -> DataFrame | None:
    """Rows of patterns found without edits, long ones anywhere, short ones as whole words, or None when these are too many for a task.

    A text is folded once and searched in one pass for the beginnings of the long and for all of the short ones. Of its
    letters only those with a beginning in them go on, as far as the join with the patterns.
    """
    begun = long.withColumns({"_whole": F.lit(False), "_piece": F.substring("pattern_compact", 1, max(SUBSTRING_LENGTH, BEGINNING))})
    worded = short.withColumns({"_whole": F.lit(True), "_piece": _framed(F.col("pattern_words"))})
    begins, runs = piece_list(begun, "_piece"), piece_list(worded, "_piece")
    if begins is None or runs is None:
        return None
    marked = lambda found, whole: F.transform(found, lambda p: F.struct(F.lit(whole).alias("whole"), p["piece"].alias("piece")))
    texts = searchable.select("_text_id", "compact", _framed(F.col("words")).alias("_words"))
    every = F.concat(marked(pieces_in(F.col("compact"), begins), False), marked(pieces_in(F.col("_words"), runs), True))
    offered = texts.withColumn("_p", F.explode_outer(every)).select(
        "_text_id", F.col("_p.whole").alias("_whole"), F.col("_p.piece").alias("_piece"), F.when(~F.col("_p.whole"), F.col("compact")).alias("_text"), "_words"
    )
    there = offered.filter(~F.col("_whole") | F.contains("_words", "_piece")).drop("_words")
    met = there.join(hint_small(begun.unionByName(worded)), ["_whole", "_piece"])
    return met.filter(F.col("_whole") | F.contains("_text", "pattern_compact"))


def _word_runs(searchable: DataFrame, short: DataFrame) -> DataFrame:
    """Rows (_text_id, and the columns of the pattern) of short patterns that stand in a text as whole words.

    Up to the size for tasks, a text is searched for all of them in one pass, and only those that it has become rows. Beyond,
    all runs of its words, as long as the longest pattern, meet the patterns.
    """
    wanted = short.withColumn("_run", _framed(F.col("pattern_words")))
    listed = piece_list(wanted, "_run")
    if listed is not None:
        texts = searchable.select("_text_id", _framed(F.col("words")).alias("_words"))
        offered = texts.withColumn("_run", F.explode_outer(pieces_in(F.col("_words"), listed))).withColumn("_run", F.col("_run.piece"))
        return offered.filter(F.contains("_words", "_run")).drop("_words").join(hint_small(wanted), "_run")
    longest = F.coalesce(short.agg(F.max(F.size(F.split("pattern_words", " "))).alias("n")).scalar(), F.lit(1))
    lengths = F.sequence(F.lit(1), F.col("_longest"))
    runs = bind(
        F.split("words", " "),
        lambda tokens: F.flatten(
            F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.transform(lengths, lambda n: F.array_join(F.slice(tokens, i, n), " ")))
        ),
    )
    return searchable.withColumn("_longest", longest).withColumn("pattern_words", F.explode_outer(F.array_distinct(runs))).join(hint_small(short), "pattern_words")


def _limit(minimum: Decimal | None) -> Column:
    return (F.lit(minimum) if minimum else F.col("threshold")).cast("decimal(12,6)")


def _won_by_join(docs: DataFrame, rules: DataFrame, minimum: Decimal | None, text: str, fuzzy: bool) -> DataFrame:
    """All rows of ``docs`` with document_type, score and signals."""
    keyed = _identified(docs, text)
    columns = ["document_type", "position", "threshold", "side", "ordinal", "weight", "name"]
    matched = _matches(keyed, rules, text, fuzzy).select("_text_id", *columns).distinct()
    signed = F.when(F.col("side") == "E", F.col("weight")).otherwise(-F.col("weight"))
    names = F.array_sort(F.collect_list(F.when(F.col("side") == "E", F.struct("ordinal", "name"))))
    scores = matched.groupBy("_text_id", "document_type", "position", "threshold").agg(
        F.when(F.count(signed) == F.count(F.lit(1)), F.sum(signed)).alias("raw"), F.transform(names, lambda n: n["name"]).alias("signals")
    )
    score = round_even(F.greatest(F.least(F.col("raw"), F.lit(Decimal(1))), F.lit(Decimal(0))), 4).cast(SCORE)
    order = lambda value: F.struct((-value).alias("s"), "position", "document_type", value.alias("score"))
    scored = scores.withColumn("score", score).filter(F.col("score") >= _limit(minimum))
    best = scored.groupBy("_text_id").agg(F.min(F.struct(*[order(F.col("score")).alias("o"), "signals"])).alias("b"))
    # A type without a hit has the score 0; among those that accept it, the first one wins.
    nought = rules.filter(_limit(minimum) <= 0).agg(F.min(order(F.lit(Decimal(0)).cast(SCORE))).alias("z"))
    joined = keyed.join(best, "_text_id", "left").join(F.broadcast(nought))
    hit = F.col("b").isNotNull() & (F.col("z").isNull() | (F.col("b.o") <= F.col("z")))
    winner = F.when(hit, F.col("b.o")).otherwise(F.col("z"))
    return joined.withColumns(
        {
            "document_type": F.coalesce(winner["document_type"], F.lit(UNKNOWN)),
            "score": winner["score"],
            "signals": F.when(hit, F.col("b.signals")).otherwise(F.array().cast("array<string>")),
        }
    ).drop("_text_id", "b", "z")


def _scored_by_join(docs: DataFrame, rules: DataFrame, text: str, minimum: Decimal | None, fuzzy: bool) -> DataFrame:
    """As ``_scored``: types with a hit are put together by joins, all others come from one row of what a type without hits looks like.

    That row is as large as the answer for one text, which holds every type of the catalogue.
    """
    keyed = _identified(docs, text)
    place = ["document_type", "side", "ordinal"]
    found = _matches(keyed, rules, text, fuzzy).groupBy("_text_id", *place).agg(F.min(F.struct("pattern_ordinal", "pattern", "edits")).alias("h"))
    types = rules.groupBy("document_type").agg(F.min(F.struct("position", _limit(minimum).alias("threshold"))).alias("t"))
    numbered = types.select("document_type", "t.threshold", (F.row_number().over(Window.orderBy("t.position", "document_type")) - 1).alias("position"))
    items = rules.select(*place, "name", F.col("weight").cast("decimal(12,6)").alias("weight")).join(numbered, "document_type")
    group = ["position", "document_type", "threshold"]

    def candidates(rows: DataFrame, by: list[str], pattern: Column, edits: Column) -> DataFrame:
        item = F.struct(
            "name", "weight", edits.isNotNull().alias("matched"), pattern.alias("pattern"),
            F.when(edits == 0, "EXACT").when(edits > 0, "FUZZY").alias("kind"), edits.alias("edits"),
        )

        def block(side: str) -> Column:
            listed = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("ordinal", item.alias("i")))))
            return F.transform(listed, lambda r: r["i"]).alias("evidence" if side == "E" else "counter")

        judged = rows.groupBy(*by, *group).agg(block("E"), block("C")).select(*by, _judged(F.struct(*group, "evidence", "counter")).alias("c"))
        return judged.groupBy(*by).agg(F.collect_list("c").alias("_some"))

    touched = found.select("_text_id", "document_type").distinct().join(items, "document_type").join(found, ["_text_id", *place], "left")
    hits = candidates(touched, ["_text_id"], F.col("h.pattern"), F.col("h.edits"))
    others = candidates(items, [], F.lit(None).cast("string"), F.lit(None).cast("int")).scalar()
    joined = keyed.join(hits, "_text_id", "left").withColumn("_others", others)
    with_hits = F.transform("_some", lambda c: c["document_type"])
    rest = F.filter("_others", lambda c: F.col("_some").isNull() | ~F.array_contains(with_hits, c["document_type"]))
    every = F.array_sort(F.when(F.col("_some").isNull(), rest).otherwise(F.concat("_some", rest)))
    length = F.length(compact_of(fold(F.col(text))))
    return joined.withColumns({"text_length": length, "_candidates": every}).drop("_text_id", "_some", "_others")


def classify_by_join(
    docs: DataFrame, rules: DataFrame, minimum: Decimal | None = None, key: str = "doc_id", text: str = "text", fuzzy: bool = False
) -> DataFrame:
    """key, document_type, score and signals against a rule table of any size: matching and scoring as joins."""
    return _won_by_join(docs.select(key, text), rules, minimum, text, fuzzy).select(key, "document_type", "score", "signals")
