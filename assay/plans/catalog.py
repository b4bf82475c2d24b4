"""All registered queries and oracles, by name."""

from __future__ import annotations

from assay.plans import (
    clean_queries, group_queries, insight_queries, io_queries, model_queries, stat_queries, usage_queries)

MODULES = [group_queries, stat_queries, clean_queries, usage_queries, model_queries,
           insight_queries, io_queries]

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in MODULES for name, q in m.ORACLE.items()}
