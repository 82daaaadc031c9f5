"""Operators put together: observation preparation, heat stress and model comparison."""
