"""Operators for preparing large text corpora.

Ten operators, one module each, plus the queries that apply them to the
supplied tables (``queries``) and the DuckDB statements of those that SQL can
state (``oracle``). Nothing else in the library imports this subpackage.
"""
