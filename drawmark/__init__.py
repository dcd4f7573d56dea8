"""Spark-native part-number detection, voting, rewriting and job tracking for engineering drawings."""
