"""functions of the agent-data engine."""
