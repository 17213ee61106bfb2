"""Composed read models and the registered queries with their SQL counterparts."""
