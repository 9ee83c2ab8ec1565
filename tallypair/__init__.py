"""Paired-choice (revealed-preference) batch jobs written with the Spark DataFrame API."""
