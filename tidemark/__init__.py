"""Point-in-time analytics over securities disclosures and daily prices, on Spark DataFrames."""
