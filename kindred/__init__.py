"""Record linkage for organisation names on PySpark DataFrames."""
