"""Market-data analytics and text preparation on Spark DataFrames."""
