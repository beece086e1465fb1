"""Sources of the claim-verification engine."""
