"""Compositions of several operators: loop closing, relocalization, map filtering."""
