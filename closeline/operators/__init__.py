"""Reusable operators: calendar, extracts, facts, classifiers, joins."""
