"""All queries of the library over the test tables, and their SQL."""

from .queries.base import ORACLES, QUERIES, query, table  # noqa: F401
from . import queries  # noqa: F401  (registers them)
