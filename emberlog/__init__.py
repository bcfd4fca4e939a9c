"""Spark-native event-log analytics: scan, decode, filter, fold, retract and read."""
