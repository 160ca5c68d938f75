"""tidemark: usage and cost analytics over session logs, as lazy Spark DataFrames."""
