"""All queries outside ``rivulet.llm`` by name, with their SQL."""

from __future__ import annotations

from rivulet.plans import evaluation, ingestion, layout, reference_checks, retrieval, stages

_PLANS = (reference_checks, retrieval, evaluation, ingestion, stages, layout)
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
