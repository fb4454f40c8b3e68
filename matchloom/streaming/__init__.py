"""Stateful smoothing of prediction streams."""
