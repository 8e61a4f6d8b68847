"""Readers and writers of event logs and graphs."""
