"""All registered queries."""

from auditlake.catalog import concepts, cover, documents, jobs, mapping, ontology, ranking, runs, similar, tabular  # noqa: F401
from auditlake.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
