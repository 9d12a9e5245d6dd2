"""Operators for preparing language-model training text on Spark.

Nothing outside this subpackage imports it; ``queries.py`` lists the queries it
contributes and ``sql.py`` their DuckDB twins.
"""
