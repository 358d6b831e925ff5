"""Registered queries: domain frames derived from the driver's tables, and library jobs on them."""

from . import catalogs, checks, files, further, promotions  # add their queries to those of .queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogs", "checks", "files", "further", "promotions"]
