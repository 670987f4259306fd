"""Runnable jobs, each also a registered query that runs it twice into a folder of its own."""
