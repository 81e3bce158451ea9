"""Recollect: analytics over layered agent memories, expressed as Spark plans."""
