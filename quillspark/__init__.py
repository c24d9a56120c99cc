"""quillspark: a PySpark-native analytics engine for market and filing data.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
keeps global state, and nothing imports the optional ``llm`` subpackage.
"""

__version__ = "0.1.0"
