"""Model-evaluation analytics on Spark: extract, grade, vote, compare, cost."""
