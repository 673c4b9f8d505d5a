"""Document-corpus analytics on Spark: ingest, retrieval, verification and evaluation as DataFrame plans."""
