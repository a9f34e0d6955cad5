"""skein: retrieval analytics over code and document collections on PySpark DataFrames."""
