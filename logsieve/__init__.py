"""logsieve: log anomaly analytics as Spark DataFrame jobs.

Sub-packages
  functions  column expressions (no shuffles): hashing, text, numeric helpers
  sources    log lines from files or event tables, the log generator, sinks
  operators  parse, tokens, splits, the context-count model, flags, metrics, report
  plans      end-to-end jobs (detect, chunked fit + evaluation) and the query registry
  streaming  the stateless part of detection on a streaming DataFrame
"""

from logsieve.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
