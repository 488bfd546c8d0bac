"""Composable PySpark operators for building and checking layered analytical tables."""
