"""Query catalogue: (spark, sf_dir) -> DataFrame, with oracle SQL beside each."""
