"""tidemark: event-time click attribution and corpus preparation on Spark."""
