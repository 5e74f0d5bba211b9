"""Document analytics for retrieval workloads, written as Spark DataFrame programs."""
