"""Streaming upkeep of the daily and hourly series (an extension: the batch pipeline does not need it)."""
