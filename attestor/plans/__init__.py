"""Plans of the claim-verification engine."""
