"""Training-data operators: sharding, deduplication, decontamination, mixing,
classifiers, token counts, media columns and web archives.

Nothing outside this subpackage imports it.
"""
