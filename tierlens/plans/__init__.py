"""Plan analysis: SQL templates, predicate checks and column lineage."""
