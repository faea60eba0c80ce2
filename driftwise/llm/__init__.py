"""Operators for building training data at scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
``registry.queries()`` and ``registry.oracle_sql()`` list what it offers.
"""
