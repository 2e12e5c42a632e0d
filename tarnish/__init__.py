"""Data-quality sensitivity jobs on Spark: feature table, seeded corruption, paired evaluation."""
