"""Page grounding, record and draft auditing over whole corpora, on Spark DataFrames."""
