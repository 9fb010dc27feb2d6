"""Training-data operators: cleaning, deduplication, decontamination, mixing and measuring of text corpora.

Nothing outside this subpackage imports it; ``tallystone.llm.queries`` registers its queries.
"""
