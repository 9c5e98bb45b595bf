"""Context analytics on Spark: profile, classify, rank, select and account for what language models read."""
