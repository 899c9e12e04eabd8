"""Lending-pipeline analytics as Spark DataFrame plans."""
