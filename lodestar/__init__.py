"""Knowledge-base retrieval and analytics on Spark DataFrames."""
