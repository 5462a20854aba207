"""Training-data operators: decontamination, language ID, extraction, deduplication, PII, sharding, ANN and mixing.

Nothing else in the library imports this subpackage; see ``granary.llm.queries`` for the registered queries.
"""
