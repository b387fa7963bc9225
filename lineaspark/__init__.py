"""Object tracking and lineage analytics on Spark."""
