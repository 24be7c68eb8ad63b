"""Prediction in queries: models trained if missing, a registry, preprocessing and metrics."""
