"""Operators of a training-data pipeline.  Nothing outside this package (and
``corpus_pipeline.py``) imports it; the named queries are in ``queries.py``."""
