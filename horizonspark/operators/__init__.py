"""Relational operators of the forecasting pipeline, as DataFrame transformations."""
