"""Runnable jobs: ``python -m jobs.NAME --help``.  Each is a function of a session, a configuration and paths."""
