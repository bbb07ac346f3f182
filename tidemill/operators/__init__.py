"""operators of the agent-data engine."""
