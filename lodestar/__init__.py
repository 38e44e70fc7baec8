"""Star-schema analytics on PySpark: declarative plans, statistics, key summaries and design advisors."""
