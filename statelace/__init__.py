"""Spark-native analytics over labelled multichannel time series, and corpus operators."""
