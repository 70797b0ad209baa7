"""marlstone: engineering analytics and text-corpus processing on Spark DataFrames."""
