"""Ordered epochs with learner state, also as a Structured Streaming sink."""
