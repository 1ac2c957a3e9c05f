"""graphloom: memory-graph analytics expressed as Spark DataFrame plans."""
