"""Change-data-capture lakehouse and mart jobs written on PySpark DataFrames."""
