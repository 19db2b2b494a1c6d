"""pricewright: a PySpark-native engine for price-book data.

Every operator takes DataFrames and returns lazy DataFrames; nothing is
collected inside a pipeline unless its size is bounded and the bound is stated.
"""

__version__ = "0.1.0"
