"""Streaming of the claim-verification engine."""
