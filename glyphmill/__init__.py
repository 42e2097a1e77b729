"""Text-block data processing on Spark DataFrames."""
