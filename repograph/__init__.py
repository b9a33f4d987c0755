"""repograph: code-graph and hybrid-search analytics on Spark."""
