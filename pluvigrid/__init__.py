"""Spark-native analytics for daily rainfall readings.

Cleaning, gap filling, monthly and seasonal roll-ups, departure from the long
period average, above-normal odds, a season forecast model and the reports on top
of them, all as ``DataFrame -> DataFrame`` functions.
"""
