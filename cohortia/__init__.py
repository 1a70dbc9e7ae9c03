"""Cohort analytics over hospital discharge records, expressed as Spark DataFrame plans."""
