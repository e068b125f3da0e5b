"""Kinetra: motion-episode analytics as Spark DataFrame plans."""
