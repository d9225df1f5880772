"""Spark-native analytics for regular time series: every operator takes and returns DataFrames."""
