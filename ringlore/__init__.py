"""Head-to-head competition analytics as Spark DataFrames."""
