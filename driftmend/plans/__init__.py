"""Rules and repair plans."""
