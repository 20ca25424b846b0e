"""Survey-document analytics on Spark: comparison of technical land-survey documents as DataFrame jobs."""
