"""Operators for preparing training data, each usable alone; ``queries`` registers them."""
