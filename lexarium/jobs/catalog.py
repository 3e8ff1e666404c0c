"""All queries of the library's jobs."""

from lexarium.jobs import composed, configs, decisions, evaluation, evidence, graphs, lifecycle, logs, references, requests, retrieval, rules, selection, stores, streams, structures, support  # noqa: F401  (each module registers its queries)
from lexarium.jobs.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
