"""Card-market analytics as composable PySpark DataFrame transforms."""
