"""Operations of a training-data pipeline: deduplication, filtering, mixing, sharding and search.

Nothing outside this subpackage imports it.
"""
