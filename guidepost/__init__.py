"""Guidance-versus-delivery analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``sources`` (readers and
sinks), ``operators`` (joins, windows, aggregates, text, graph, retrieval),
``plans`` (scoring and analyst composites), ``streaming`` (stateful jobs) and
``catalog`` (the registered queries with their SQL twins).
"""
