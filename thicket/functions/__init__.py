"""Column functions and ordered arithmetic over DataFrames."""
