"""Panel analytics on Spark: long tables in, long tables out."""
