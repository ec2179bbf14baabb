"""Interaction-network analytics as Spark DataFrame operators."""
