"""Operators of the claim-verification engine."""
