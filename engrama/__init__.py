"""Analytics for long-lived agent memory, as Spark DataFrame operators."""
