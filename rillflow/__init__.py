"""Windowed, keyed and event-time data processing as plain functions from DataFrame to DataFrame."""
