"""wattle: smart-meter (AMI) analytics as plain Spark DataFrame operators.

Every operator is a pure ``DataFrame -> DataFrame`` function built from
native Spark columns, joins, aggregates and windows, so Catalyst can push
filters into the scan, prune columns and plan the shuffles.

Sub-packages
------------
sources    readers, schemas, sinks and the derived test views
functions  scalar column builders shared by the operators
operators  cleaning, measure splits, pivots, windows, audits, joins
plans      compositions of operators into the end-to-end workflows
streaming  the stateless cleaning steps run on a streaming DataFrame
"""

__version__ = "0.1.0"
