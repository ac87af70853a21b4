"""meshspark: graph analytics on PySpark DataFrames."""
