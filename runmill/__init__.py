"""A sort-centred data-processing library over Spark DataFrames."""
