"""Structured Streaming twins: job state, line feeds, running scores."""
