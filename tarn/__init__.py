"""tarn: sorted-set, set, key/value and ranked-retrieval analytics on Spark DataFrames."""
