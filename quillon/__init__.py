"""Analytics on hierarchical, documented, cross-referenced data, as Spark DataFrame plans."""
