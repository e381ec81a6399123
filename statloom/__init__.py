"""statloom: multivariate statistics and designed experiments on Spark DataFrames."""
