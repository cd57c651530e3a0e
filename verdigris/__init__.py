"""Verdigris: prompt-evaluation analytics expressed as Spark DataFrame plans."""
