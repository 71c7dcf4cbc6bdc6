"""Evaluation and telemetry operators as plain DataFrame functions."""
