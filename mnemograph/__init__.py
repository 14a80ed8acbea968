"""Set-oriented agent-memory analytics on Spark DataFrames."""
