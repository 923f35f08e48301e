"""Table analytics on PySpark: composable DataFrame operators and ready-made queries."""
