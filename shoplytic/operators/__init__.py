"""Analytic operators over the shop's tables."""
