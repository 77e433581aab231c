"""Brazilian identifiers: normal form and check digits as arithmetic on characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartorio.functions.expressions import bind
from cartorio.functions.folding import fold

# The 27 federative units.
STATES = {
    "AC": "ACRE", "AL": "ALAGOAS", "AP": "AMAPA", "AM": "AMAZONAS", "BA": "BAHIA", "CE": "CEARA",
    "DF": "DISTRITO FEDERAL", "ES": "ESPIRITO SANTO", "GO": "GOIAS", "MA": "MARANHAO", "MT": "MATO GROSSO",
    "MS": "MATO GROSSO DO SUL", "MG": "MINAS GERAIS", "PA": "PARA", "PB": "PARAIBA", "PR": "PARANA",
    "PE": "PERNAMBUCO", "PI": "PIAUI", "RJ": "RIO DE JANEIRO", "RN": "RIO GRANDE DO NORTE",
    "RS": "RIO GRANDE DO SUL", "RO": "RONDONIA", "RR": "RORAIMA", "SC": "SANTA CATARINA",
    "SP": "SAO PAULO", "SE": "SERGIPE", "TO": "TOCANTINS",
}

# Weights of the company number and of the voter title.
CNPJ_FIRST = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
CNPJ_SECOND = (6, *CNPJ_FIRST)
VOTER_FIRST = (2, 3, 4, 5, 6, 7, 8, 9)
REPEATED = r"^(.)\1*$"


def _at(text: Column, position: int) -> Column:
    """Value of the character at a 1-based position, digits counting from 0."""
    return F.ascii(F.substring(text, position, 1)) - F.lit(48)


def weighted_sum(text: Column, weights, start: int = 1) -> Column:
    total = F.lit(0)
    for offset, weight in enumerate(weights):
        total = total + _at(text, start + offset) * F.lit(weight)
    return total


def _normalized(value: Column, mask: str, shape: str) -> Column:
    return bind(F.regexp_replace(value, mask, ""), lambda bare: F.when(bare.rlike(shape), bare))


def cpf_normalize(value: Column) -> Column:
    return _normalized(value, r"[./\- \t]", r"^[0-9]{11}\z")


def cnpj_normalize(value: Column) -> Column:
    return _normalized(fold(value), r"[./\- \t]", r"^[0-9A-Z]{12}[0-9]{2}\z")


def cnh_normalize(value: Column) -> Column:
    return _normalized(value, r"[.\- \t]", r"^[0-9]{11}\z")


def cep_normalize(value: Column) -> Column:
    return _normalized(value, r"[.\- \t]", r"^(?!0{8})[0-9]{8}\z")


def voter_normalize(value: Column) -> Column:
    return _normalized(value, r"[^0-9]", r"^[0-9]{12}\z")


def rg_normalize(value: Column) -> Column:
    """Letters in front dropped, 7 to 10 letters and digits left."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(value), "[^0-9A-Z]", ""), "^[A-Z]+", "")
    return F.when(F.length(bare).between(7, 10), bare)


def state_normalize(value: Column) -> Column:
    """Two-letter code from a code or a state name, accents and case ignored."""
    codes = F.create_map(*[F.lit(x) for code, name in STATES.items() for x in (name, code, code, code)])
    return F.try_element_at(codes, fold(value))


# The digit rules below are written so that each weighted sum occurs once: "ten counts as zero"
# is a remainder of ten, and "eleven minus the rest, zero for rests below two" is two remainders.


def _cpf_digit(text: Column, count: int) -> Column:
    return weighted_sum(text, range(count + 1, 1, -1)) * 10 % 11 % 10


def cpf_valid(normal: Column) -> Column:
    return (~normal.rlike(REPEATED)) & (_cpf_digit(normal, 9) == _at(normal, 10)) & (_cpf_digit(normal, 10) == _at(normal, 11))


def _cnpj_digit(text: Column, weights) -> Column:
    return (F.lit(11) - weighted_sum(text, weights) % 11) % 11 % 10


def cnpj_valid(normal: Column) -> Column:
    return (
        (~F.substring(normal, 1, 12).rlike(REPEATED))
        & (_cnpj_digit(normal, CNPJ_FIRST) == _at(normal, 13))
        & (_cnpj_digit(normal, CNPJ_SECOND) == _at(normal, 14))
    )


def cnh_valid(normal: Column) -> Column:
    """A first rest of ten gives digit 0 and takes two off the second sum."""
    def judge(rest: Column) -> Column:
        second = (weighted_sum(normal, range(1, 10)) % 11 - F.floor(rest / 10) * 2 + 11) % 11 % 10
        return (rest % 10 == _at(normal, 10)) & (second == _at(normal, 11))

    return (~normal.rlike(REPEATED)) & bind(weighted_sum(normal, range(9, 0, -1)) % 11, judge)


def voter_valid(normal: Column) -> Column:
    """In units 1 and 2 a rest of zero gives digit 1."""
    def judge(unit: Column) -> Column:
        digit = lambda total: bind(total % 11, lambda r: F.when(unit.isin(1, 2) & (r == 0), 1).otherwise(r % 10))

        def second(first: Column) -> Column:
            return (first == _at(normal, 11)) & (digit(weighted_sum(normal, (7, 8), start=9) + first * 9) == _at(normal, 12))

        return unit.between(1, 28) & bind(digit(weighted_sum(normal, VOTER_FIRST)), second)

    return (~normal.rlike(REPEATED)) & bind(_at(normal, 9) * 10 + _at(normal, 10), judge)


# kind -> (normal form, verdict on the normal form or None, code when right)
KINDS = {
    "CPF": (cpf_normalize, cpf_valid),
    "CNPJ": (cnpj_normalize, cnpj_valid),
    "CNH": (cnh_normalize, cnh_valid),
    "VOTER": (voter_normalize, voter_valid),
    "CEP": (cep_normalize, None),
    "RG": (rg_normalize, None),
    "UF": (state_normalize, None),
}
