"""Query plans: the declarative language and its translation into Spark plans."""
