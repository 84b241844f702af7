"""Graph-aware placement of integer triples on Spark."""

__version__ = "0.1.0"
