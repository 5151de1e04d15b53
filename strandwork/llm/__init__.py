"""Training-data operators: language ID, deduplication, packing, formatting, scans and materialisation.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and ``__spark_entry__.py`` use it if it is there.
"""
