"""Operations of a training-data pipeline: cleaning, deduplication, scoring, mixing, tokenising.

Nothing outside this subpackage imports it.
"""
