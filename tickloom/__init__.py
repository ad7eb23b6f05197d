"""Tickloom: operational telemetry as Spark DataFrames.

Points (dimension columns and a value) become slots (time slot, key, range,
value); requests read slots back as values, distributions and heatmaps.
"""
