"""sparkseek: a hybrid retrieval and catalog analytics engine on Spark DataFrames."""
