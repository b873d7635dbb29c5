"""coppice: recurring groups in free-text records, as Spark DataFrame plans."""
