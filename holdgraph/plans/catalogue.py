"""The engine's queries over the driver's tables, and the SQL that each must equal."""

from holdgraph.plans import aggregates, expansion, exports, linkage, loading, mapping, overlays, ownership, packets, payloads, resolution, risk, scalars, selection, stream, texts, timeline  # noqa: F401
from holdgraph.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "chain_depth"
