"""The library's own queries."""

from strandlake.plans import discovery, formats, selections, sequences, statistics  # noqa: F401
from strandlake.plans.registry import QUERIES, SQL
