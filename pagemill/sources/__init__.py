"""Readers and writers of files, stage tables, logs and documents."""
