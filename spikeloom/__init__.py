"""Spike-train jobs on Spark: DataFrame in, DataFrame out, keyed by recording."""
