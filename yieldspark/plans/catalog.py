"""Queries of the library's own operators and the SQL that checks them."""

from __future__ import annotations

from yieldspark.plans import control, evaluation, training, experiments, exploration, relational, series, training

_PLANS = (relational, control, evaluation, training, experiments, series, exploration)
QUERIES = {k: q for p in _PLANS for k, q in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in _PLANS for k, s in p.ORACLE_SQL.items()}
