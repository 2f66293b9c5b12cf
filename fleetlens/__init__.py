"""Operations analytics on Spark DataFrames and Structured Streaming."""
