"""seamark: lineage analytics and table operators on PySpark DataFrames."""
