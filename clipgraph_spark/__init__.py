"""Set-oriented analytics over timed transcripts and text corpora, on Spark DataFrames."""
