"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from tidemark.llm import ann, branch_merge, chat, exact_dedup, fingerprints, lm_scoring, merkle, mixing, ngram_join, packing, quality, token_counts, warc

MODULES = (ann, branch_merge, chat, exact_dedup, fingerprints, lm_scoring, merkle, mixing, ngram_join, packing, quality, token_counts, warc)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
