"""Compilation of filters and options to one lazy DataFrame."""
