"""Training-data operators: dedup, language, quality, toxicity, decontamination, BPE, URLs, vectors, licences.

Nothing else in the package imports this subpackage.  ``queries()`` and
``oracle_sql()`` of :mod:`scriptorium.llm.queries` are what the driver entry adds.
"""
