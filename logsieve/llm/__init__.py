"""Operators of a training-data pipeline, each a Spark job with one registered query
(`logsieve.llm.queries`).  Nothing else in the library imports this subpackage."""
