"""Sparkwright: relational, retrieval and text preparation operators as plain PySpark."""
