"""All queries outside the training-data subpackage, and their DuckDB SQL."""

from . import registry
from .functions import scalar
from .operators import aggregates, joins, rows, sets, windows
from .plans import retrieval, vectors
from .sources import scans
from .streaming import events, stateful

MODULES = (scans, rows, joins, aggregates, windows, sets, scalar, retrieval, vectors, events, stateful)
QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
