"""tallyglass: questions and SQL over star schemas, answered by Spark as chart-ready data."""
