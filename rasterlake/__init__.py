"""Image-table analytics on PySpark: rasters, glyphs, frames and classifiers as DataFrames."""
