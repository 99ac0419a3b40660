"""Evidence retrieval, evaluation and record lifecycle as Spark plans."""
