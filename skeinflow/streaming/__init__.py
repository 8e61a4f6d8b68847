"""Graphs of logs that still grow."""
