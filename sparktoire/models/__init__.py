"""Estimators: repertoire features, convergent clusters, sequence-level models and their ensemble."""
