"""Agent-data engine on Spark: catalogue queries, sources, event folding and functions as DataFrame transforms."""
