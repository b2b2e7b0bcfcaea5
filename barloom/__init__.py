"""Spark jobs that keep large collections of OHLCV price bars in order."""
