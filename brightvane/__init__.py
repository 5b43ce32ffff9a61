"""A content-intelligence engine on Spark DataFrames."""
