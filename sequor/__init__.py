"""Interval, sequence and metric operators for building sequence datasets on Spark."""
