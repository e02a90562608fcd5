"""Motif discovery: expectation maximisation, regular expressions, gapped alignment, modification sites."""
