"""Named queries over the driver's tables, each with the DuckDB SQL that returns the same rows."""

from siftwell.plans import registry
from siftwell.plans import citations, dashboards, evaluation, extraction, graph, graph_walks, records, repair, resolution, retrieval, samples, syncing, text  # noqa: F401  they register their queries

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL
FLAGSHIP = "st02_vectorless"
