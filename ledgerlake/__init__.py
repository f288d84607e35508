"""ledgerlake: a PySpark-native engine for company-filing analytics.

Sub-packages: ``sources`` (readers and seeds), ``functions`` (column expressions and small
vectorised kernels), ``operators`` (DataFrame -> DataFrame operators), ``plans`` (query
catalogue, marts, quality reports) and ``streaming`` (incremental ingest).
"""
