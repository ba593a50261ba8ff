"""loomlake: conversation-memory analytics on Spark DataFrames."""
