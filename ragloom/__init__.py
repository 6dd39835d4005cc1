"""ragloom: retrieval preparation and request analytics as Spark jobs.

Sub-packages:
  functions/  column expressions (text, vectors, scoring) and fixed lexicons
  operators/  DataFrame -> DataFrame operators (clean, validate, route, knn, ...)
  sources/    readers and writers (text corpora, label files, app logs, index store)
  streaming/  Structured Streaming jobs (incremental index, rate limits)
  plans/      the registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
