"""storyloom: batch text analytics for article collections on Spark.

Groups articles by (year, category), prepares and cleans their intros,
weighs tokens by TF-IDF into document vectors, clusters documents in 1-D,
finds topics with keywords, names and sentiment per cluster, and extracts
subject–relation–object triples.  Every operator takes and returns
DataFrames; group, cluster and topic are columns.
"""

__all__ = ["functions", "operators", "plans", "sources", "session"]
