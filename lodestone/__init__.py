"""Knowledge-graph analytics and corpus preparation as PySpark DataFrame jobs."""
