"""Spark jobs for text-corpus analytics with gated model review."""
