"""Timed-text corpus engine for PySpark: cue tables in, cue tables and reports out."""
