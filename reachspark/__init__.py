"""Accessibility and equity analytics as Spark plans."""
