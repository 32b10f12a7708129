"""Job-posting analytics on Spark: cleaning, merging and querying a postings corpus."""
