"""Operators over records: signals, rules, resolution, matching, overlays, evidence, views, metrics, evaluation."""
