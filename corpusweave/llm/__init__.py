"""Operators of a training-data pipeline: quality rules, deduplication, mixing, tokens, packing.

Nothing else in the library imports this subpackage; `catalog` holds its registered queries."""
