"""Training-data operators: token counts, deduplication, quality, toxicity, language, decontamination.

Nothing outside this subpackage imports it; the queries over the operators are in ``roadloom.llm.queries``.
"""
