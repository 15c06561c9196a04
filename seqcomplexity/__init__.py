"""Sequence-complexity analytics on PySpark."""
