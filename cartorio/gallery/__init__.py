"""Example queries over the star-schema tables, with the SQL they are checked against."""

from cartorio.gallery import cards, evaluation, flow, geometry, lifecycle, relational, texts, values  # noqa: F401
from cartorio.gallery.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
