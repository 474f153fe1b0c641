"""All queries of the library with their SQL, by name."""

from __future__ import annotations

from .plans import graph_plans, knowledge_plans, lookup_plans, object_plans, recognise_plans, record_plans, rule_plans, structure_plans, text_plans

_ALL = (text_plans.P, record_plans.P, graph_plans.P, object_plans.P, recognise_plans.P, lookup_plans.P, rule_plans.P, structure_plans.P, knowledge_plans.P)
FLAGSHIP = "search_topk"
QUERIES = {name: q for p in _ALL for name, q in p.queries.items()}
ORACLES = {name: sql for p in _ALL for name, sql in p.oracles.items()}
