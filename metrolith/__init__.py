"""Metrolith: location-and-time analytics as composable PySpark transformations."""
