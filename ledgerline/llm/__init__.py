"""Operators for preparing training corpora: dedup, language ID, packing, search and the like.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
