"""Typed scans, parameterised sources, landed pages, staging and the sink."""
