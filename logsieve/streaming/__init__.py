"""Detection on streams: stateless flags as a streaming projection, and model scoring
per micro-batch against a stored model and threshold."""

from logsieve.streaming.detect import flag_stream, detect_stream, StoredDetector

__all__ = ["flag_stream", "detect_stream", "StoredDetector"]
