"""Instrumentation specs and metric definitions."""
