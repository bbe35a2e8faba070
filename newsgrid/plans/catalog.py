"""All registered queries."""

from . import catalog_relational, catalog_rules, catalog_scans, catalog_texts  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
