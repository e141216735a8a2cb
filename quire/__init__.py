"""quire: Spark-native operators for retail, subscription, ledger and
clickstream analytics.

Layout
------
``sources``    typed table scans, the fixture views, sinks (materialise, append)
``functions``  Column-expression helpers (calendars, dirty text, ratios)
``operators``  parameterised DataFrame -> DataFrame operators (W02..W58)
``plans``      the query catalogue: operators bound to the fixture views,
               each with an independent DuckDB oracle statement
``streaming``  incremental (Structured Streaming) forms of batch operators

Every operator is a composition of built-in Spark functions; none ships a
Python UDF on its hot path.
"""

from quire.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
