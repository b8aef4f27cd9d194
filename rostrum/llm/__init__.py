"""Training-data operators: deduplication, decontamination, quality, mixing and token output.

Nothing outside this package imports it; `rostrum.llm.queries` holds the registered queries.
"""
