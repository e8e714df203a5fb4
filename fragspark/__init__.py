"""fragspark: fragment analytics as Spark DataFrames."""

from fragspark.session import ship

__all__ = ["ship"]
