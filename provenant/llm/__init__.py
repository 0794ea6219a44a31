"""Training-data operators: mixing, quality, token output, secret and license scans, language id,
embedding and text deduplication, decontamination and similarity joins.

Nothing outside this subpackage imports it; its registered queries are in ``provenant.llm.queries``.
"""
