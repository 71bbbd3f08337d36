"""Operators of a training-data pipeline, one module each; see ``queries.py`` for their registered queries."""
