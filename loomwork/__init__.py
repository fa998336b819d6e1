"""loomwork: analytics over event logs, software graphs and text corpora, as Spark jobs."""
