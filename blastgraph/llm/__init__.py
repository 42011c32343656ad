"""Operators of a training-data pipeline: one module per operator.

Nothing outside this package (but ``corpus_pipeline.py`` and the guarded part of
``__spark_entry__.py``) imports it; deleting it leaves the rest of the library whole.
"""
