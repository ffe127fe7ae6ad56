"""Time-series analytics on Spark: points, buckets, replicas, catalogues and codecs as tables and DataFrame operators."""
