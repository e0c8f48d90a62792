"""Sources and sinks for episodes and datasets."""
