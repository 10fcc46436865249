"""Distributed text jobs and fleet-state analytics as lazy Spark DataFrame operators."""
