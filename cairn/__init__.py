"""cairn: raster, vector and point-cloud analytics as Spark DataFrame jobs."""
