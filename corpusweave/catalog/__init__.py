"""All registered queries."""

from . import corpus, files, flows, noise, pairs, scores, text, vectors, vocabulary  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
