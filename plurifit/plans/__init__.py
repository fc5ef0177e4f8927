"""Compositions: estimators, search, final fit, scoring, whole campaigns."""
