"""Terratally: aerial asset analytics as Spark DataFrames.

Detections, raster pixels, video frames and model responses are tables;
every operator takes and returns DataFrames or Columns.
"""
__version__ = "0.1.0"
