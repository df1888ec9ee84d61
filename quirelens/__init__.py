"""Document analytics on Spark: layout features, stacked classification, exposure reports."""
