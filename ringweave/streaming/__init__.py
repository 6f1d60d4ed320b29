"""Replay of circuit lines as they arrive."""
