"""Session analytics over long per-player event histories, on Spark DataFrames."""
