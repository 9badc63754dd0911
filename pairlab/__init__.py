"""pairlab: analytics for paired, repeated and grouped observations on Spark."""
