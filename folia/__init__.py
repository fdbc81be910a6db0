"""folia: archive analytics expressed as PySpark DataFrames."""
