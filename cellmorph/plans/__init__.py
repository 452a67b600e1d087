"""Whole queries made of operators."""
