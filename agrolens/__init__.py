"""agrolens: agricultural decision analytics as Spark DataFrame jobs."""
