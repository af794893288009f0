"""Readers and writers: history samples, settings, nested records, CSV, logs."""
