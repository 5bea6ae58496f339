"""Evidence search over document corpora, as Spark DataFrame plans."""
