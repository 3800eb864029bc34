"""ragloom: retrieval and telemetry analytics as Spark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns a DataFrame (or a
Column); nothing collects data to the driver. Sub-packages:

* ``sources``   – readers and writers (CSV, JSON, logs, file listings, parquet tables)
* ``operators`` – predicates, joins, vector search, aggregates, windows, ordering, table changes
* ``functions`` – Column -> Column helpers (text cleaning, prompt augmentation, encoders)
* ``plans``     – composed jobs (ingest, RAG, reports) and the query catalogue
* ``streaming`` – Structured Streaming forms of the online operators
"""

__version__ = "0.1.0"
