"""Text and hypergraph analytics as PySpark DataFrame operators."""
