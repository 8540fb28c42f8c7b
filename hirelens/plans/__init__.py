"""Adapters from the driver tables and the registered queries."""
