"""Skew-safe building blocks for order-dependent work."""
