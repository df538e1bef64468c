"""tarmac: flight-operations analytics as PySpark DataFrame operators.

Operators live in ``tarmac.operators``, input tables in ``tarmac.sources``, skew-safe window and
quantile helpers in ``tarmac.functions``, streaming variants in ``tarmac.streaming`` and the
registered queries (each with its DuckDB twin) in ``tarmac.plans``.
"""
