"""millrace: DataFrame and SQL operators for messy tables, on PySpark."""
