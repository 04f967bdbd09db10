"""Operators of a training-data pipeline (deduplication, archives, quality,
token counts, mixing, sharding, search).  Nothing else in the package imports
this subpackage."""
