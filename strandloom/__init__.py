"""strandloom: sequence-similarity analytics and corpus preparation on PySpark DataFrames."""
