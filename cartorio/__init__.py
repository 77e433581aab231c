"""Document intelligence on Spark: DataFrame operators over captured page text."""

__version__ = "0.1.0"
