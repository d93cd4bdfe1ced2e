"""Operators for training data made of conversations and documents; nothing outside imports this."""
