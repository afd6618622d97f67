"""deucebase: sequence-level sports analytics on Spark DataFrames."""
