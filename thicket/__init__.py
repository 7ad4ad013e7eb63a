"""Graph sparsification and community-structure analytics on Spark DataFrames."""
