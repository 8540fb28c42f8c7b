"""DataFrame operators over the model tables."""
