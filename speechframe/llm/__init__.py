"""Training-data operators (WARC, dedup, decontamination, tokenising, ...).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when the subpackage is present.
"""
