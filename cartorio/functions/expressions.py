"""Small expression builders shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (lambdas would inline it otherwise).

    The value is the start of a fold over nothing, and ``body`` its last step: unlike a transform of an array of one,
    this copies no result, which nested steps would do once each.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def all_of(conditions: Iterable[Column | None]) -> Column:
    """Conjunction of the predicates that are present; no predicate means no restriction."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def first_case(cases: Iterable[tuple[Column, Column | str | None]], otherwise=None) -> Column:
    """Ordered CASE: the first condition that holds gives the value."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    rest = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return chain.otherwise(rest)


def text_array(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def trim_chars(value: Column, chars: str) -> Column:
    """Strip any of ``chars`` from both ends."""
    return F.btrim(value, F.lit(chars))


def round_even(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)


def equals_if(column: Column, value) -> Column | None:
    """Equality predicate, absent when there is nothing to compare with."""
    return None if value is None else column == F.lit(value)


def at_rank(value: Column, order: Iterable[str]) -> Column:
    """Position of a value in a fixed list, from 0; null for anything else."""
    return first_case([(value == name, F.lit(rank)) for rank, name in enumerate(order)])


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keeps large expressions of equal arguments for as long as the JVM they live in: building one takes thousands of calls."""
    kept: dict = {}

    @wraps(build)
    def get(*given):
        key = (id(SparkContext._gateway), *given)
        if key not in kept:
            kept[key] = build(*given)
        return kept[key]

    return get
