"""Operators of a training-data pipeline: one module per operator.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries, ``oracle`` the DuckDB SQL of those that SQL can express.
"""
