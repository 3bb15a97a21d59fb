"""Training-data pipeline operators: ten stand-alone Spark operators and the queries that apply them.

Nothing outside this subpackage imports it; it can be removed without touching the rest.
"""
