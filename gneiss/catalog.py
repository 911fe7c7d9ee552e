"""Every registered query with its DuckDB counterpart."""

from gneiss.jobs import agents, answering, calculations, evaluation, retrieval, scoring, standards

_FAMILIES = (calculations, retrieval, evaluation, answering, scoring, standards, agents)
QUERIES: dict = {k: v for family in _FAMILIES for k, v in family.QUERIES.items()}
ORACLES: dict = {k: v for family in _FAMILIES for k, v in family.ORACLES.items()}
