"""The benchmark suites, on the tables at hand."""

from . import caching, forum, jsonfeed, operators, tpch, webhits

QUERIES = {**tpch.QUERIES, **webhits.QUERIES, **forum.QUERIES, **jsonfeed.QUERIES, **operators.QUERIES, **caching.QUERIES}
ORACLES = {k: q.oracle for k, q in QUERIES.items() if hasattr(q, "oracle")} | jsonfeed.ORACLES | operators.ORACLES | caching.ORACLES
