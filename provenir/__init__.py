"""Evidence analytics on Spark: document corpora whose answers are traceable to their source text."""
