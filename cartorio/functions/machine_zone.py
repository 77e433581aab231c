"""Three-line machine-readable zones (30 characters each) as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = 30


def clean(text: Column) -> Column:
    return F.translate(F.upper(text), "«‹ ", "<<")


def looks_like(text: Column) -> Column:
    """28 to 32 characters of the zone alphabet, three fillers or more."""
    return text.rlike(r"^[0-9A-Z<]{28,32}\z") & text.rlike("<[^<]*<[^<]*<")


def restore_fillers(text: Column) -> Column:
    short = F.length(text).between(27, 29) & text.endswith("<")
    return F.when(short, F.rpad(text, LINE, "<")).otherwise(text)


def _value(letter: Column) -> Column:
    """Digits count as themselves, letters from ten, fillers as nothing."""
    return F.instr(F.lit("123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), letter)


def check_digit(text: Column) -> Column:
    """Weights 7, 3, 1 over and over."""
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    parts = F.transform(F.split(text, "(?!$)"), lambda c, i: _value(c) * F.get(weights, i % 3))
    return F.aggregate(parts, F.lit(0), lambda s, v: s + v) % 10


def _agrees(field: Column, digit: Column) -> Column:
    return digit.rlike("^[0-9]$") & (check_digit(field).cast("string") == digit)


def _date(field: Column, today: date, birth: bool) -> Column:
    year = F.lit(today.year // 100 * 100) + F.substring(field, 1, 2).try_cast("int")
    if birth:
        year = F.when(year > today.year, year - 100).otherwise(year)
    iso = F.concat(year.cast("string"), F.lit("-"), F.substring(field, 3, 2), F.lit("-"), F.substring(field, 5, 2))
    return F.when(field.rlike("^[0-9]{6}$"), F.try_to_date(iso, "yyyy-MM-dd"))


def reading(first: Column, second: Column, third: Column, today: date) -> Column:
    """Struct of the parts and the four verdicts; null unless the three lines fit."""
    number, birth, expiry = F.substring(first, 6, 9), F.substring(second, 1, 6), F.substring(second, 9, 6)
    composite = F.concat(F.substring(first, 6, 25), F.substring(second, 1, 7), F.substring(second, 9, 7), F.substring(second, 19, 11))
    born, ends = _date(birth, today, True), _date(expiry, today, False)
    verdicts = [
        _agrees(number, F.substring(first, 15, 1)),
        _agrees(birth, F.substring(second, 7, 1)),
        _agrees(expiry, F.substring(second, 15, 1)),
        _agrees(composite, F.substring(second, 30, 1)),
    ]
    parts = F.struct(
        F.rtrim(F.substring(first, 1, 2), F.lit("<")).alias("document_code"),
        F.substring(first, 3, 3).alias("issuing_state"),
        F.rtrim(number, F.lit("<")).alias("document_number"),
        born.alias("birth_date"),
        ends.alias("expiration_date"),
        F.substring(second, 16, 3).alias("nationality"),
        F.trim(F.translate(F.replace(third, F.lit("<<"), F.lit(" / ")), "<", " ")).alias("names"),
        verdicts[0].alias("number_valid"),
        verdicts[1].alias("birth_valid"),
        verdicts[2].alias("expiry_valid"),
        verdicts[3].alias("composite_valid"),
    )
    shape = r"^[0-9A-Z<]{30}\z"
    return F.when(first.rlike(shape) & second.rlike(shape) & third.rlike(shape), parts)


def fully_valid(read: Column) -> Column:
    """All four check digits right and both dates on the calendar."""
    digits = read["number_valid"] & read["birth_valid"] & read["expiry_valid"] & read["composite_valid"]
    return F.coalesce(digits & read["birth_date"].isNotNull() & read["expiration_date"].isNotNull(), F.lit(False))
