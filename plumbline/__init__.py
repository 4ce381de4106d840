"""Prediction-reliability and dataset-hygiene analytics on Spark DataFrames."""
