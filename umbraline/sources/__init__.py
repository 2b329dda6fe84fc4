"""Readers and writers: audit logs, corpora, configuration, message tables."""
