"""Readers and writers: files, manifests, logs, chunk stores, index tables."""
