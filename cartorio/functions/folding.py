"""Accent folding and comparison keys as built-in column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything the folding treats as white space: controls 9..13, NEL and the separators.
SPACES = r"[\t-\r \x{85}\p{Z}]+"
MARKS = r"\p{Mn}+"
NOT_WORD = r"[^\p{L}\p{Nd}]+"


def _upper(char: str) -> str:
    """Simple upper case: one character to one, never from outside ASCII into it."""
    upper = char.upper()
    if len(upper) != 1 or (ord(char) > 127 and ord(upper) < 128):
        return char
    return upper


def _base(char: str, form: str) -> str:
    kept = [c for c in unicodedata.normalize(form, char) if unicodedata.category(c) != "Mn"]
    return _upper(kept[0]) if len(kept) == 1 else _upper(char)


@lru_cache
def fold_table(form: str = "NFD") -> tuple[str, str]:
    """(from, to) strings for ``translate``, generated from the Unicode decomposition rules for all of its characters."""
    pairs = []
    for code in (*range(ord("a"), ord("z") + 1), *range(0x80, sys.maxunicode + 1)):
        char = chr(code)
        if not (unicodedata.decomposition(char) or char.upper() != char) or unicodedata.category(char) == "Mn":
            continue
        base = _base(char, form)
        if base != char:
            pairs.append((char, base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def fold_chars(text: Column, form: str = "NFD") -> Column:
    """Same-length folding: every character becomes its upper-case base."""
    source, target = fold_table(form)
    return F.translate(text, source, target)


def fold(text: Column) -> Column:
    """Upper case without accents, white space collapsed; null becomes the empty string."""
    bare = F.regexp_replace(fold_chars(F.coalesce(text, F.lit(""))), MARKS, "")
    return F.trim(F.regexp_replace(bare, SPACES, " "))


def words_of(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, NOT_WORD, " "))


def compact_of(folded: Column) -> Column:
    return F.regexp_replace(folded, NOT_WORD, "")


def fold_compat(text: Column) -> Column:
    """Compatibility folding used by the privacy scan; white space is left as it is."""
    return F.regexp_replace(fold_chars(text, "NFKD"), MARKS, "")


def normalize_text(df, text: str = "text"):
    """Adds ``folded``, ``words`` and ``compact`` next to a text column."""
    return (
        df.withColumn("folded", fold(F.col(text)))
        .withColumn("words", words_of(F.col("folded")))
        .withColumn("compact", F.regexp_replace(F.col("words"), " ", ""))
    )


def clean_person_name(text: Column) -> Column:
    """Folded name with letters, blanks, hyphens and apostrophes only; null unless it looks like a name:
    two words or more, one of them of three letters."""
    kept = F.regexp_replace(F.regexp_replace(fold(text), r"[^A-Za-z '\-]+", ""), " +", " ")
    cleaned = F.trim(kept)
    return F.when(cleaned.contains(" ") & cleaned.rlike("[^ ]{3,}"), cleaned)
