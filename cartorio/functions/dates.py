"""Brazilian dates and money as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartorio.functions.expressions import bind
from cartorio.functions.folding import fold

MINIMUM_PLAUSIBLE = date(1900, 1, 1)
# Month names in long dates.
MONTHS = (
    "JANEIRO", "FEVEREIRO", "MARCO", "ABRIL", "MAIO", "JUNHO",
    "JULHO", "AGOSTO", "SETEMBRO", "OUTUBRO", "NOVEMBRO", "DEZEMBRO",
)
_SEPARATORS = "[/. -]+"


def _parts(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), _SEPARATORS), lambda p: p != "")


def _checked(year: Column, month: Column, day: Column) -> Column:
    """The date, or null when it is not on the calendar."""
    iso = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year != "0000", F.try_to_date(iso, "yyyy-MM-dd"))


def parse_date(value: Column) -> Column:
    """Day, month and four-digit year between any of the separators."""
    def read(parts: Column) -> Column:
        day, month, year = (F.get(parts, F.lit(i)) for i in range(3))
        fits = (F.size(parts) == 3) & day.rlike("^[0-9]{1,2}\\z") & month.rlike("^[0-9]{1,2}\\z") & year.rlike("^[0-9]{4}\\z")
        return F.when(fits, _checked(year, month, day))

    return bind(_parts(value), read)


def parse_long_date(value: Column) -> Column:
    """``day DE month-name DE year``, accents and case ignored."""
    def read(parts: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(parts, F.lit(2)))
        day, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(4))
        fits = (
            (F.size(parts) == 5)
            & (F.get(parts, F.lit(1)) == "DE")
            & (F.get(parts, F.lit(3)) == "DE")
            & (month > 0)
            & day.rlike("^[0-9]{1,9}\\z")
            & year.rlike("^[0-9]{4}\\z")
        )
        short = F.regexp_replace(day, "^0+(?=[0-9])", "")
        return F.when(fits & (F.length(short) <= 2), _checked(year, month.cast("string"), short))

    return bind(F.filter(F.split(fold(value), "[ ,]+"), lambda p: p != ""), read)


def parse_month(value: Column) -> Column:
    """``mm/yyyy`` as ``yyyy-mm``."""
    def read(parts: Column) -> Column:
        month, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        fits = (
            (F.size(parts) == 2)
            & month.rlike("^(?:0?[1-9]|1[0-2])\\z")
            & year.rlike("^[0-9]{4}\\z")
            & (year >= str(MINIMUM_PLAUSIBLE.year))
        )
        return F.when(fits, F.concat_ws("-", year, F.lpad(month, 2, "0")))

    return bind(_parts(value), read)


def plausible(value: Column, kind: Column, today: date) -> Column:
    """Birth and issue lie in the past; other dates may reach fifty years ahead."""
    latest = F.when(kind.isin("BIRTH", "ISSUE"), F.lit(today)).otherwise(F.add_months(F.lit(today), 600))
    return value.between(F.lit(MINIMUM_PLAUSIBLE), latest)


def iso(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def parse_money(value: Column) -> Column:
    """Optional ``R$``, groups of three after the first, optional two decimals; as text with two decimals."""
    bare = F.trim(F.regexp_replace(F.trim(value), r"^(?i:R\$)", ""))
    fits = bare.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+)(?:,[0-9]{2})?\z")
    plain = F.translate(F.regexp_replace(bare, r"\.", ""), ",", ".")
    amount = F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".00")))
    tidy = F.regexp_replace(amount, r"^0+(?=[0-9])", "")
    return F.when(fits, tidy)
