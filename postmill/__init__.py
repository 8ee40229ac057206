"""postmill: case processing and analytics for business correspondence, on Spark DataFrames."""
