"""Registered queries over the given tables, each with its SQL counterpart where SQL can express it."""

from . import cleaning, evaluation, files, networks, similarity  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
