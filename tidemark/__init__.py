"""Activity recovery, job-text mining and evidence tables as lazy PySpark operators."""
