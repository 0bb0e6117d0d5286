"""Stateful streaming forms of the per-session operators."""
