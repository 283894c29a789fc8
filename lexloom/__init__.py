"""lexloom: statute-corpus building, retrieval and auditing as Spark DataFrame jobs."""
