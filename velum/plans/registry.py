"""All registered queries."""

from velum.plans import chat, columns, corpora, kb, payloads, streams, text  # noqa: F401
from velum.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
