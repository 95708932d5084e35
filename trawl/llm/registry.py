"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from trawl.llm import byte_bpe, cap_filters, collocations, katz, mixing, pii, prefix_trie, ring, simhash, tiff, token_counts, warc, weak_labels

MODULES = (cap_filters, mixing, katz, token_counts, tiff, simhash, byte_bpe, ring, weak_labels, pii, collocations, warc, prefix_trie)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
