"""Security-timeline analytics as composable PySpark DataFrame functions."""
