"""A Spark-first analytics engine: typed tables, SQL, learned join orders and a console."""
