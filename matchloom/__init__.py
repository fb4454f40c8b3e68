"""Matchloom: matching, evaluation and corpus preparation as Spark DataFrame jobs."""
