"""Evidence retrieval, citation checking and evaluation over document tables, as Spark plans."""
