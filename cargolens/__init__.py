"""Shipment-cost analytics on Spark DataFrames: detectors, views, evaluation, data quality and generation."""
