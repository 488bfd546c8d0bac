"""Training-data operators; ``queries()`` and ``oracle_sql()`` are in ``llm.registry``."""
