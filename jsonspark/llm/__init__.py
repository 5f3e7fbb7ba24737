"""Training-data operators: quality rules, near-dedup, scans, tokenisers, models.

Nothing outside this folder (but for the optional registration in
``__spark_entry__.py``) imports this subpackage.
"""
