"""Whole plans: recognition, back-fill, reports, and the registered queries."""
