"""How fast a stream takes input, and how it ends."""

from __future__ import annotations

from pyspark.sql.streaming import DataStreamReader, StreamingQuery

#: Files that one batch takes, as a session's queue holds frames.
QUEUE = 16


def limited(reader: DataStreamReader, files: int = QUEUE) -> DataStreamReader:
    """Back-pressure: a batch takes at most ``files`` files, the rest waits for the next."""
    return reader.option("maxFilesPerTrigger", files)


def drain(query: StreamingQuery) -> int:
    """Finish what has arrived, take nothing more, and stop; the number of batches that had rows."""
    try:
        query.processAllAvailable()
        return len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
    finally:
        query.stop()
