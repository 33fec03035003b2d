"""casewise: case-level safety analytics and training-data operators on Spark DataFrames."""
