"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it, apart from the guarded import in
``__spark_entry__.py``.
"""
