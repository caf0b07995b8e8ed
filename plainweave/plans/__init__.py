"""Whole plans: from texts to feature vectors, and the registered queries."""
