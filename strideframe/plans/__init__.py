"""Named pipelines, and the registered queries."""

from strideframe.plans import q_episodes, q_recording, q_signals, q_vectors, q_views
from strideframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "q_episodes", "q_recording", "q_signals", "q_vectors", "q_views"]
