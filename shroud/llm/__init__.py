"""Training-data pipeline operators.

One module per operator; ``queries`` registers the thin ``opN_<name>`` queries
and ``oracles`` their DuckDB SQL. Nothing else in the library imports this
subpackage.
"""
