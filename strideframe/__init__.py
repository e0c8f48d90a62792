"""Episode-structured, multi-rate sensor and action data on Spark."""
