"""Number-plate analytics and corpus operators on Spark DataFrames."""
