"""All registered queries."""

from . import graphs, links, profiles, relational, scalar, scans, semantics, streams  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
