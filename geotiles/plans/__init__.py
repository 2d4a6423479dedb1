"""Multi-step plans."""
