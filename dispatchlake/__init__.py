"""Message-dispatch analytics on Spark: routing, delivery history, metrics."""
