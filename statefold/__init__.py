"""Keyed-state analytics on Spark: changelogs of state operations, folded by DataFrame plans."""
