"""Structured Streaming forms of batch operators.

``visits``: the visit summary (W57) from mergeable partial rows per micro-batch,
with an idempotent changelog.
"""
