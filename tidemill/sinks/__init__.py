"""Sinks: batching writers, upserts, documents, key-value tables, files and logs."""
