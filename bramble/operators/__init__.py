"""Operators over graphs whose nodes are numbered in the order of their names."""
