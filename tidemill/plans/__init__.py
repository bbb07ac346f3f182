"""plans of the agent-data engine."""
