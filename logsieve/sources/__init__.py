"""Sources (log files, event tables, the generator) and sinks."""

from logsieve.sources.logs import clean_lines, read_log_lines, logs_from_events, training_log_from_events

__all__ = ["clean_lines", "read_log_lines", "logs_from_events", "training_log_from_events"]
