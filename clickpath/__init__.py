"""clickpath: Spark-native funnel, attribution and e-commerce analytics.

Everything is expressed as DataFrame operations that Catalyst plans and
executors run: no Python row functions, no driver-side loops.

Layout
------
- ``sources``    table loading, the driver-data adapters, CSV ingest, sinks
- ``functions``  column helpers (exact percent, money ratios, month difference)
- ``operators``  reusable DataFrame -> DataFrame building blocks (views,
                 funnel rates, cohort retention, recency, basket pairs, checks)
- ``plans``      the named analyses, one module per topic, and the registry
- ``oracle``     independent DuckDB SQL for every registered analysis
"""

from clickpath.session import get_spark  # noqa: F401
