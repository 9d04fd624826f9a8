"""crowdrank: rank items by what people write about them, on Spark.

Public functions take and return DataFrames; nothing is collected.
"""

__version__ = "0.1.0"
