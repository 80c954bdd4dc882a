"""HTML documents as queryable tables on Spark."""
