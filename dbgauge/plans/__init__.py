from dbgauge.plans import capability_queries, catalog_queries, log_queries, record_queries, stream_queries

MODULES = [log_queries, catalog_queries, capability_queries, record_queries, stream_queries]


def all_queries():
    """Name to ``(spark, sf_dir) -> DataFrame`` of every registered query."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles():
    """Name to the SQL that states the expected rows from the source tables."""
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
