"""sieveworks: record enrichment, entity resolution and evidence analytics on Spark DataFrames."""
