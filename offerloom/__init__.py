"""Offer matching and procurement analytics as Spark DataFrame jobs."""
