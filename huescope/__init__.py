"""Colour summaries of large collections of raster images, on Spark."""
