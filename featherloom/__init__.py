"""Feature-dependency analytics and corpus preparation on PySpark DataFrames."""
