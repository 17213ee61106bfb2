"""Operators over payloads, results, errors and runs of all accounts at once."""
