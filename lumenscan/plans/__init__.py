"""Named queries: (spark, sf_dir) -> DataFrame, with their SQL where SQL can say it."""
