"""Operators for preparing large text corpora.

Nothing outside this folder (and the guarded registration in
``__spark_entry__.py``) imports it.
"""
