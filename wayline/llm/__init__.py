"""Training-corpus operators: deduplication, retrieval, tokenisation, scoring, redaction, formatting and mixing."""
