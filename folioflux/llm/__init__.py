"""Training-data operators: filtering, deduplication, decontamination, redaction and mixing of text corpora."""
