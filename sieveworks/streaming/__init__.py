"""Folds of event logs as streams."""
