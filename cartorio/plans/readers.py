"""Typed readers: what a candidate text is worth for a field, as arrays of ranked alternatives.

An alternative says in which pass it may be chosen. The smallest (pass, position) of a field wins, so
"first valid near a label, else first valid anywhere, else first rejected" is a minimum, not a loop.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartorio.functions import check_digits as digits
from cartorio.functions.dates import iso, parse_date, parse_money, parse_month, plausible
from cartorio.functions.expressions import bind, first_case, text_array, trim_chars
from cartorio.functions.folding import clean_person_name, fold
from cartorio.operators.quality import (
    CHECK_DIGIT_INVALID, CHECK_DIGIT_VALID, DATE_INVALID, DATE_VALID, DOCUMENT_EXPIRED, FORMAT_VALID, POSTAL_CODE_VALID, STATE_VALID,
)
from cartorio.plans.types import LICENCE_CATEGORIES, MAX_PARTNERS
from cartorio.sources.lines import trim_blank

# Shapes of values in running text.
S = r"[\s\x{85}\p{Z}]"
CPF = rf"(?<![0-9])[0-9]{{3}}\.?{S}?[0-9]{{3}}\.?{S}?[0-9]{{3}}{S}?-?{S}?[0-9]{{2}}(?![0-9])"
CNPJ = (
    rf"(?<![0-9A-Za-z])(?:[0-9A-Za-z]{{2}}\.{S}?[0-9A-Za-z]{{3}}\.{S}?[0-9A-Za-z]{{3}}{S}?/{S}?[0-9A-Za-z]{{4}}{S}?-{S}?[0-9]{{2}}|[0-9]{{14}})"
    r"(?![0-9A-Za-z])"
)
DATE = r"(?<![0-9])[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{4}(?![0-9])"
DATE_SPACED = r"(?<![0-9])[0-9]{1,2} {1,2}[0-9]{1,2} {1,2}[0-9]{4}(?![0-9])"
MONTH_YEAR = r"(?<![0-9])[0-9]{1,2}[/.\-][0-9]{4}(?![0-9])"
POSTAL_CODE = rf"(?<![0-9])[0-9]{{2}}\.?[0-9]{{3}}{S}?-?{S}?[0-9]{{3}}(?![0-9])"
MONEY = rf"(?:R\${S}?)?[0-9]{{1,3}}(?:\.[0-9]{{3}})*,[0-9]{{2}}(?![0-9])"
ACTIVITY_CODE = r"(?<![0-9])[0-9]{2}\.[0-9]{2}-[0-9](?:-[0-9]{2})?(?![0-9])"
RG = r"(?<![0-9A-Za-z])(?:[A-Za-z]{2}-?)?[0-9]{1,2}\.?[0-9]{3}\.?[0-9]{3}(?:-?[0-9Xx])?(?![0-9A-Za-z])"
ELEVEN_DIGITS = r"(?<![0-9])[0-9]{11}(?![0-9])"
STREET_START = (
    r"^(?:RUA|AV|AVENIDA|ALAMEDA|AL|TRAVESSA|TV|PRACA|PCA|RODOVIA|ROD|ESTRADA|EST|LARGO|VIA|VIELA|QUADRA|SQN|SQS|SHIN|SHIS)\b\.?"
)
CITY_AND_STATE = rf"([A-Z][A-Z' ]{{2,60}}?){S}*[-/,]{S}*([A-Z]{{2}})\b"
CATEGORY_VALID = "CATEGORY_VALID"
FALLBACK = 0.30
#: Readers whose shapes have a digit in every match.
DIGIT_READERS = ("DATE", "CPF", "CNPJ", "CPF_OR_CNPJ", "CEP", "MONEY", "RG", "CNH", "MONTH")
assert MAX_PARTNERS > 0

ALTERNATIVE = (
    "struct<path:string,pass:int,raw:string,normalized:string,status:string,messages:array<string>,extra:double,found:boolean>"
)


def alternative(path: Column | str, pass_: int, raw: Column | None, normalized: Column | None, status: str = "VALID",
                messages: Column | list[str] = (), extra: float = 0.0, found: bool = True) -> Column:
    none = F.lit(None).cast("string")
    codes = messages if isinstance(messages, Column) else text_array(messages)
    return F.struct(
        (F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(pass_).alias("pass"),
        (none if raw is None else raw).alias("raw"), (none if normalized is None else normalized).alias("normalized"),
        F.lit(status).alias("status"), codes.alias("messages"), F.lit(float(extra)).alias("extra"), F.lit(found).alias("found"),
    )


def missing(path: Column | str, pass_: int) -> Column:
    return alternative(path, pass_, None, None, "NOT_FOUND")


def listed(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast(f"array<{ALTERNATIVE}>")


def matches(text: Column, shape: str) -> Column:
    return F.regexp_extract_all(text, F.lit(shape), F.lit(0))


def first_match(text: Column, shape: str) -> Column:
    found = F.regexp_extract(text, shape, 0)
    return F.when(found != "", found)


def checked(text: Column, shape: str, normalize, valid) -> Column:
    """struct<first, first_normal, right, right_normal>: first match, and the first with right digits."""
    pairs = F.transform(matches(text, shape), lambda m: F.struct(m.alias("raw"), normalize(m).alias("n")))
    return bind(
        pairs,
        lambda p: bind(
            F.get(F.filter(p, lambda x: x["n"].isNotNull() & valid(x["n"])), F.lit(0)),
            lambda good: F.struct(
                F.get(p, F.lit(0))["raw"].alias("first"), F.get(p, F.lit(0))["n"].alias("first_normal"),
                good["raw"].alias("right"), good["n"].alias("right_normal"),
            ),
        ),
    )


def cpf_checked(text: Column) -> Column:
    return checked(text, CPF, digits.cpf_normalize, digits.cpf_valid)


def cnpj_checked(text: Column) -> Column:
    return checked(text, CNPJ, digits.cnpj_normalize, digits.cnpj_valid)


def near_number(path, found: Column) -> Column:
    """Near a label: right digits in pass 1, a rejected first match in pass 3."""
    return bind(found, lambda c: listed(
        F.when(c["right"].isNotNull(), alternative(path, 1, c["right"], c["right_normal"], messages=[CHECK_DIGIT_VALID])),
        F.when(c["first_normal"].isNotNull(), alternative(path, 3, c["first"], None, "INVALID", [CHECK_DIGIT_INVALID], FALLBACK, False)),
    ))


def anywhere_number(path, found: Column, rejected: bool) -> Column:
    """Anywhere: right digits in pass 2, and where wanted a rejected first match in pass 4."""
    def read(c: Column) -> Column:
        items = [F.when(c["right"].isNotNull(), alternative(path, 2, c["right"], c["right_normal"], messages=[CHECK_DIGIT_VALID], extra=FALLBACK))]
        if rejected:
            items.append(F.when(c["first_normal"].isNotNull(), alternative(path, 4, c["first"], None, "INVALID", [CHECK_DIGIT_INVALID], FALLBACK)))
        return listed(*items)

    return bind(found, read)


def read_date(path: Column, text: Column, kind: Column, today: date) -> Column:
    texts = F.concat(matches(text, DATE), matches(text, DATE_SPACED))
    parsed = F.transform(texts, lambda m: F.struct(m.alias("raw"), parse_date(m).alias("day")))

    def read(items: Column) -> Column:
        right = F.get(F.filter(items, lambda i: F.coalesce(plausible(i["day"], kind, today), F.lit(False))), F.lit(0))
        wrong = F.get(F.filter(items, lambda i: ~F.coalesce(plausible(i["day"], kind, today), F.lit(False))), F.lit(0))
        codes = lambda r: F.when((kind == "EXPIRATION") & (r["day"] < F.lit(today)), text_array([DATE_VALID, DOCUMENT_EXPIRED])).otherwise(text_array([DATE_VALID]))
        return bind(right, lambda r: listed(
            F.when(r.isNotNull(), alternative(path, 1, r["raw"], iso(r["day"]), messages=codes(r))),
            bind(wrong, lambda w: F.when(w.isNotNull(), alternative(path, 2, w["raw"], None, "INVALID", [DATE_INVALID], FALLBACK, False))),
        ))

    return bind(parsed, read)


def read_name(path: Column, text: Column, following: Column) -> Column:
    """A name on the line, or one word continued on the lines below."""
    first = trim_chars(fold(text), " ,.")
    start = F.struct(F.lit(False).alias("stop"), F.trim(text).alias("raw"), first.alias("text"))

    def step(s: Column, line: Column) -> Column:
        more = trim_chars(fold(line["text"]), " ,.")
        stop = s["stop"] | ~more.rlike("^[A-Za-z ]+$")
        return F.struct(
            stop.alias("stop"),
            F.when(stop, s["raw"]).otherwise(F.concat_ws(" ", s["raw"], F.trim(line["text"]))).alias("raw"),
            F.when(stop, s["text"]).otherwise(F.concat_ws(" ", s["text"], more)).alias("text"),
        )

    joined = F.aggregate(F.slice(following, 1, 2), start, step, lambda s: F.struct(s["raw"].alias("raw"), clean_person_name(s["text"]).alias("name")))
    several = F.when(first.rlike("^[A-Za-z]{3,}$"), joined)
    return bind(clean_person_name(text), lambda own: bind(several, lambda s: listed(
        F.when(own.isNotNull(), alternative(path, 1, F.trim(text), own)).otherwise(F.when(s["name"].isNotNull(), alternative(path, 1, s["raw"], s["name"])))
    )))


def read_text(path: Column, text: Column, minimum: Column) -> Column:
    cleaned = trim_chars(fold(text), " -:.,")
    return bind(cleaned, lambda c: listed(F.when(
        ~(c.startswith("(") & c.endswith(")")) & (F.length(c) >= minimum) & c.rlike("[A-Za-z0-9]"), alternative(path, 1, F.trim(text), c)
    )))


def read_single(path: Column, raw: Column, normalized: Column, code: str) -> Column:
    return bind(F.struct(raw.alias("r"), normalized.alias("n")), lambda v: listed(F.when(v["n"].isNotNull(), alternative(path, 1, v["r"], v["n"], messages=[code]))))


def read_activity(text: Column) -> Column:
    """Code and description from the first candidate that has either."""
    code = first_match(text, ACTIVITY_CODE)
    rest = F.when(code.isNotNull(), F.array_join(F.split(text, ACTIVITY_CODE, 2), " ")).otherwise(text)

    def read(v: Column) -> Column:
        words = trim_chars(fold(v["rest"]), " -:.,/")
        told = (F.length(words) >= 3) & words.rlike("[A-Za-z]")
        some = v["code"].isNotNull() | told
        plain = F.regexp_replace(v["code"], "[^0-9]", "")
        return listed(
            F.when(some & v["code"].isNotNull(), alternative("mainActivityCode", 1, v["code"], plain, messages=[FORMAT_VALID])),
            F.when(some & v["code"].isNull(), missing("mainActivityCode", 1)),
            F.when(told, alternative("mainActivityDescription", 1, trim_chars(v["rest"], " -:"), words)),
            F.when(some & ~told, missing("mainActivityDescription", 1)),
        )

    return bind(F.struct(code.alias("code"), rest.alias("rest")), read)


def read_registration(path: Column, text: Column) -> Column:
    raw = first_match(text, ELEVEN_DIGITS)
    return bind(raw, lambda r: listed(
        F.when(r.isNotNull() & digits.cnh_valid(r), alternative(path, 1, r, r, messages=[CHECK_DIGIT_VALID]))
        .otherwise(F.when(r.isNotNull(), alternative(path, 2, r, None, "INVALID", [CHECK_DIGIT_INVALID], FALLBACK, False)))
    ))


def read_address(path: Column, text: Column) -> Column:
    cleaned = trim_chars(fold(text), " -:.,")
    return bind(cleaned, lambda c: listed(F.when((F.length(c) >= 5) & c.rlike("[0-9]") & c.rlike("[A-Za-z]"), alternative(path, 1, F.trim(text), c))))


def read_month(path: Column, text: Column) -> Column:
    parsed = F.filter(F.transform(matches(text, MONTH_YEAR), lambda m: F.struct(m.alias("raw"), parse_month(m).alias("n"))), lambda p: p["n"].isNotNull())
    return bind(F.get(parsed, F.lit(0)), lambda p: listed(F.when(p.isNotNull(), alternative(path, 1, p["raw"], p["n"], messages=[DATE_VALID]))))


def read_candidate(reader: Column, path: Column, text: Column, following: Column, minimum: Column, kind: Column, today: date) -> Column:
    """Alternatives of one candidate, by the reader of its field."""
    category = F.regexp_replace(fold(text), "[^A-Z]", "")
    return first_case(
        [
            (reader == "DATE", read_date(path, text, kind, today)),
            (reader == "NAME", read_name(path, text, following)),
            (reader == "TEXT", read_text(path, text, minimum)),
            (reader == "CPF", near_number(path, cpf_checked(text))),
            (reader == "CNPJ", near_number(path, cnpj_checked(text))),
            (reader == "CPF_OR_CNPJ", F.concat(near_number("holderDocument#cnpj", cnpj_checked(text)), near_number("holderDocument#cpf", cpf_checked(text)))),
            (reader == "CEP", read_single(path, first_match(text, POSTAL_CODE), digits.cep_normalize(first_match(text, POSTAL_CODE)), POSTAL_CODE_VALID)),
            (reader == "STATE", read_single(path, F.trim(text), digits.state_normalize(trim_chars(F.trim(text), "-/:.")), STATE_VALID)),
            (reader == "MONEY", read_single(path, first_match(text, MONEY), parse_money(first_match(text, MONEY)), FORMAT_VALID)),
            (reader == "RG", read_single(path, first_match(text, RG), digits.rg_normalize(first_match(text, RG)), FORMAT_VALID)),
            (reader == "CATEGORY", read_single(path, F.trim(text), F.when(category.isin(*LICENCE_CATEGORIES), category), CATEGORY_VALID)),
            (reader == "CNH", read_registration(path, text)),
            (reader == "ADDRESS", read_address(path, text)),
            (reader == "MONTH", read_month(path, text)),
            (reader == "ACTIVITY", read_activity(text)),
        ],
        listed(),
    )


def city_and_state(folded_text: Column) -> Column:
    """First ``CITY - UF`` of a folded text with a real unit: struct<city, uf>, null without one."""
    bare = F.replace(F.regexp_replace(folded_text, POSTAL_CODE, " "), F.lit("CEP"), F.lit(" "))

    def pairs(text: Column) -> Column:
        cities = F.regexp_extract_all(text, F.lit(CITY_AND_STATE), F.lit(1))
        units = F.regexp_extract_all(text, F.lit(CITY_AND_STATE), F.lit(2))
        both = F.zip_with(cities, units, lambda c, u: F.struct(trim_chars(c, " -/,").alias("city"), u.alias("uf")))
        return F.get(F.filter(both, lambda p: p["uf"].isin(*digits.STATES) & (F.length(p["city"]) >= 3)), F.lit(0))

    return bind(bare, pairs)


def after_colon(text: Column) -> Column:
    return trim_blank(F.substr(text, F.instr(text, ":") + 1))
