"""The registered queries: each applies an operator to geometry that is derived from the driver's tables.

``fixtures`` defines that geometry twice, for Spark and as SQL, so that DuckDB can compute every answer arithmetically.
"""
