"""Operators of training-data pipelines, each by one named method."""
