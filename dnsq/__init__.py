"""DNS threat analytics on Spark: flows, features, detectors and reports as DataFrame jobs."""
