"""Whole jobs: the layered pipeline, the measures and the report questions."""
