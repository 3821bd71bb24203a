"""Whole runs from declarations, and the registered queries."""
