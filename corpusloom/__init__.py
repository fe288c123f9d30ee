"""corpusloom: Spark-native corpus analytics.

Every public operator is a lazy ``DataFrame -> DataFrame`` function built on
Spark SQL expressions, joins, windows and aggregates.  Sub-packages:

* ``functions``  column expressions (text, numbers, arrays, tokens)
* ``operators``  DataFrame operators (joins, labels, statistics, splits, ...)
* ``sources``    table catalog, derived inputs, file readers and sinks
* ``plans``      composed jobs and the registry of named queries
* ``streaming``  incremental (availableNow) file processing
"""

__version__ = "0.1.0"
