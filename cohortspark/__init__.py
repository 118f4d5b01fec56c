"""Spark-native analytics over agents, cells, rasters, genomes and ancestry graphs."""
