"""sources of the agent-data engine."""
