"""prefspark: preference-data building and analysis as Spark jobs.

- ``sources``: input adapters, dataset loaders, the registry, file sources/sinks
- ``functions``: Column-level scalars (text, tokens, losses, HTML)
- ``operators``: positions, batching, matching, reports, Bradley-Terry fits
- ``plans``: the registered queries and their DuckDB oracles
- ``streaming``: Structured Streaming jobs

Entry points for a driver are in ``__spark_entry__.py`` at the repository root.
"""
