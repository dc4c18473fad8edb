"""rankloom: a Spark-native engine for ranked-candidate datasets.

Every operator is a function from DataFrames to a DataFrame; plans stay lazy until a sink or an explicit
checkpoint.  See README.md for the layout.
"""

__version__ = "0.1.0"
