"""Siltsieve: rule-based data cleaning on Spark, in batch and in streams."""
