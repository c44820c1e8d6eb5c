"""Cohort classification and multichannel-series statistics as Spark DataFrame jobs."""
