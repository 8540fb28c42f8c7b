"""Training-data operators over a documents table. Nothing else in the package imports this."""
