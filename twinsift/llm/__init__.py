"""Operators for training-data pipelines.

Nothing outside this subpackage imports it, apart from ``corpus_pipeline`` and
the guarded import of the driver entry.
"""
