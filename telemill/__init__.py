"""Cluster-telemetry analytics on Spark.

Everything is ``DataFrame -> DataFrame`` or ``Column -> Column``; widths, steps, prices and
label patterns are parameters. Sub-packages: ``functions`` (column expressions), ``sources``
(readers and dimensions), ``operators`` (the building blocks), ``plans`` (end-to-end jobs),
``streaming`` (the same work on streams) and ``catalog`` (registered queries over the test tables).
"""
