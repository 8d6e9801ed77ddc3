"""Readers, writers, the task registry and the views derived from the test tables."""
