"""Functions of the claim-verification engine."""
