"""barloom: point-in-time equity screening and research as Spark DataFrame operators."""
