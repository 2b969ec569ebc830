"""rasterloom: merging stacks of images, and raster analytics, on Spark DataFrames."""

__version__ = "0.1.0"
