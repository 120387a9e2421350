"""Training-data operators: tokenising, packing, dedup, scans, language and quality models.

Nothing outside this subpackage imports it; `tabulon.llm.registry` lists its queries.
"""
