"""The registered queries: all over whole tables."""

from cinelake.plans import markup, relational, release, search, text, upkeep, vectors
from cinelake.plans._base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "markup", "relational", "release", "search", "text", "upkeep", "vectors"]
