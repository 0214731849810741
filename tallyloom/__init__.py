"""A Spark-first engine for chat orders: parse, reconcile, merge, evaluate."""
