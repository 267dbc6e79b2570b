"""Composed plans: the recommendation flow and the driver query catalog."""
