"""Row-by-row ingestion with Structured Streaming."""
