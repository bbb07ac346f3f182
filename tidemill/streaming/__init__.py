"""streaming of the agent-data engine."""
