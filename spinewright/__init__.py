"""Entity resolution, lead discovery and corpus preparation on PySpark DataFrames."""
