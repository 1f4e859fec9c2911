"""Market-data analytics as Spark DataFrame jobs: validate, reconcile, feature, score, gate."""
