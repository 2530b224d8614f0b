"""Evaluations that combine operators."""
