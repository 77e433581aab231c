"""Rule catalogue: JSON rows to profiles, with rejects reported instead of raised."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartorio.bounds import CATALOGUE_LIMIT_ROWS, catalogue_rows
from cartorio.functions.expressions import first_case
from cartorio.functions.folding import fold, words_of

_ITEM = "array<struct<name:string,weight:decimal(12,6),patterns:array<string>>>"
RULES_SCHEMA = f"struct<evidence:{_ITEM},counterEvidence:{_ITEM},threshold:decimal(12,6),_corrupt:string>"


def load_rules(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule rows, rejects) of the active types.

    Input columns: document_type, position (tie order), active, rules_json. Rule rows have one row
    per evidence: document_type, position, threshold, side E or C, ordinal, name, weight, patterns.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = types.filter("active").withColumn("r", F.from_json("rules_json", RULES_SCHEMA, options))
    threshold = F.coalesce("r.threshold", F.lit(Decimal(0)))
    reason = first_case(
        [
            (F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "invalid JSON"),
            (F.coalesce(F.size("r.evidence"), F.lit(0)) < 1, "evidence must have at least one entry"),
            ((threshold < 0) | (threshold > 1), "threshold must be between 0 and 1"),
        ]
    )
    judged = parsed.withColumn("reason", reason.cast("string")).withColumn("threshold", threshold)
    good = judged.filter(F.col("reason").isNull())

    def side(column: str, letter: str) -> DataFrame:
        rows = good.select("document_type", "position", "threshold", F.lit(letter).alias("side"), F.posexplode(column).alias("ordinal", "e"))
        return rows.select(
            "document_type", "position", "threshold", "side", "ordinal",
            F.col("e.name").alias("name"), F.col("e.weight").alias("weight"),
            F.coalesce("e.patterns", F.array().cast("array<string>")).alias("patterns"),
        )

    rules = side("r.evidence", "E").unionByName(side("r.counterEvidence", "C"))
    return rules, judged.filter(F.col("reason").isNotNull()).select("document_type", "reason")


def pattern_rows(rules: DataFrame) -> DataFrame:
    """One row per pattern with its comparison keys."""
    long = rules.select("*", F.posexplode("patterns").alias("pattern_ordinal", "pattern")).drop("patterns")
    keyed = long.withColumn("pattern_words", words_of(fold(F.col("pattern"))))
    return keyed.withColumn("pattern_compact", F.regexp_replace("pattern_words", " ", ""))


@dataclass(frozen=True)
class Pattern:
    id: int
    text: str
    words: str
    compact: str


@dataclass
class Evidence:
    name: str
    weight: Decimal
    patterns: list[Pattern] = field(default_factory=list)


@dataclass
class Profile:
    document_type: str
    position: int
    threshold: Decimal
    evidence: list[Evidence] = field(default_factory=list)
    counter: list[Evidence] = field(default_factory=list)

    @property
    def patterns(self) -> list[Pattern]:
        return [p for item in (*self.evidence, *self.counter) for p in item.patterns]


def collect_profiles(rules: DataFrame) -> list[Profile] | None:
    """The catalogue as plan-time constants, or None when it is too large for that."""
    exploded = rules.select("*", F.posexplode_outer("patterns").alias("pattern_ordinal", "pattern")).drop("patterns")
    keyed = exploded.withColumn("pattern_words", words_of(fold(F.col("pattern"))))
    rows = catalogue_rows(keyed, CATALOGUE_LIMIT_ROWS)
    if rows is None:
        return None
    rows.sort(key=lambda r: (r["position"], r["document_type"], r["side"] == "C", r["ordinal"], r["pattern_ordinal"] or 0))
    profiles: dict[str, Profile] = {}
    for number, row in enumerate(rows):
        profile = profiles.setdefault(row["document_type"], Profile(row["document_type"], row["position"], row["threshold"]))
        items = profile.evidence if row["side"] == "E" else profile.counter
        if row["ordinal"] == len(items):
            items.append(Evidence(row["name"], row["weight"]))
        if row["pattern"] is not None:
            words = row["pattern_words"]
            items[-1].patterns.append(Pattern(number, row["pattern"], words, words.replace(" ", "")))
    return list(profiles.values())


def profile_json(evidence: Mapping[str, tuple[str, Iterable[str]]], counter=None, threshold: str = "0.60") -> str:
    """Rules JSON of a profile given as name -> (weight, patterns)."""
    def items(block):
        return [{"name": n, "weight": float(w), "patterns": list(p)} for n, (w, p) in (block or {}).items()]

    return json.dumps({"evidence": items(evidence), "counterEvidence": items(counter), "threshold": float(threshold)})
