"""Training-data operators: dedup, classification, extraction, tokens, packing.

Nothing outside this subpackage imports it; queries and SQL are in
``queries.py``.
"""
