"""Ready-made Spark jobs over message streams, run logs and experiment tables."""
