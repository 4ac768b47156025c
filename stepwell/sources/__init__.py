"""Where outputs live: files through Spark's Hadoop connectors, memory, and the run history."""
