"""Structured Streaming variants of ingestion and monitoring."""
