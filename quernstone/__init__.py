"""Cohort, evaluation and corpus analytics on Spark DataFrames."""
