"""Operators that prepare text and figures for training; nothing outside this package imports it."""
