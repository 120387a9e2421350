"""Sheet algebra and legacy office documents on Spark DataFrames."""
