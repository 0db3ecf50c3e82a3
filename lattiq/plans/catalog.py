"""All registered queries of the engine."""

from . import ladder, networks, pipelines, reports, selection  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
