"""Comorbidity scoring as lazy Spark DataFrame jobs."""
