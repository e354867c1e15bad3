"""Materialisation, and the registered queries."""
