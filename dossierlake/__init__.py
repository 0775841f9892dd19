"""Document-review analytics on Spark: rule corpora, retrieval, opinion mining, audits, structure."""
