"""The query catalogue: each operator bound to the fixture views, with its DuckDB oracle.

``registry.queries()`` / ``registry.oracle_sql()`` back ``__spark_entry__.py``;
``compare`` holds the Spark-vs-DuckDB comparison used by the tools and tests.
"""
